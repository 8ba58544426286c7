"""The reports: functions from prepared frames to a result frame."""
