"""Personal data and the terms that give it away, by information-theoretic sanitisation.

Base matches (e-mail, ip, card, phone) are the protected entities. Every word of a
document that stands outside its matches is a candidate term for the entities of the
document. With D the number of documents, PMI(term, entity) = log2(D(both) N /
(D(term) D(entity))) is the information that the term gives about the entity, and
IC(entity) = log2(N / D(entity)) all there is to give. A term reveals when its PMI is
at least ``DISCLOSURE`` of the IC and the corpus bears it out, which is judged thrice:

- for an entity of ``MIN_TEXTS`` distinct texts or more by itself: the term stands
  beside it in ``MIN_TEXTS`` distinct texts or more;
- for rarer entities by kind: those of one kind count together as one entity, and
  besides ``MIN_TEXTS`` the chance that all documents with the term hold the kind
  without any relation, (D(kind) / N) ^ D(both), must be below 2 ^ -``EVIDENCE``;
- for each entity, however rare, by its own value: a word of an e-mail address needs
  no number of texts, as the address itself ties them.

Any other term of one or two texts is not sensitive: each word that occurs once would
give all of the IC. A sensitive term is a match of the kind ``term`` at all its places
in all documents that hold the entity (for a kind: a rare entity of it). Counts run
over all rows, texts by their hash; words inside base matches do not count as terms.

Sanitising puts the kind's general name in place of a match (``generalise``) or
removes it.

Only DataFrame functions are used. Places are code points, ends exclusive. Null
texts count as empty and stay null when sanitised. Rows are matched by themselves,
so repeated rows get equal results; they count each as a document, but once among the
distinct texts. Extra columns are carried or ignored; an empty table
gives an empty one.

Repeated groups in the patterns are possessive and local parts begin where a run
begins (or the last match ended): what is matched stays the same, but the time is
linear and the stack bounded on very long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.shared import field, stored

KINDS = ("email", "ip", "card", "phone", "term")
# fixed patterns
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD = r"\p{L}{3,}"

DISCLOSURE = 0.9
MIN_TEXTS = 3
#: Bits by which a term of a kind must be beyond chance.
EVIDENCE = 20
#: Code points of a text that are searched for words at a time.
PIECE = r"(?s).{1,4000}+\p{L}*+"

FOUND = T.ArrayType(T.StructType([field("start", "int"), field("end", "int"), field("value", "string")]))
SPAN = T.StructType([field("start", "int"), field("kind", "int"), field("end", "int"), field("value", "string")])


def places(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern, as (start, end, value).

    The lengths of the pieces between the matches give the places.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(gaps, values, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("found"))

    def add(so_far: Column, step: Column) -> Column:
        at = so_far["at"] + step["gap"]
        end = at + F.length(step["value"])
        one = F.struct(at.alias("start"), end.alias("end"), step["value"].alias("value"))
        more = F.struct(end.alias("at"), F.concat(so_far["found"], F.array(one)).alias("found"))
        return F.when(step["value"].isNull(), so_far).otherwise(more)

    return F.aggregate(steps, start, add, lambda so_far: so_far["found"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less nine above nine."""
    backwards = F.split(F.reverse(digits), "")

    def weigh(digit: Column, i: Column) -> Column:
        n = F.coalesce(digit.cast("int"), F.lit(0))
        double = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when(i % 2 == 1, double).otherwise(n)

    return F.aggregate(F.transform(backwards, weigh), F.lit(0), lambda n, x: n + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda part: F.length(part) <= 3
        parts = F.transform(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+", ""))
        return F.forall(parts, lambda p: small(p) & (F.coalesce(F.when(small(p), p).try_cast("int"), F.lit(0)) <= 255))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    return F.length(digits).between(9, 15)


def _spans(text: Column, kind: str) -> Column:
    """Valid base matches of one kind; texts that cannot hold one skip the search."""
    pattern, may = {
        "email": (EMAIL, F.contains(text, F.lit("@"))),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]")),
        "card": (CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){11}")),
        "phone": (PHONE, F.contains(text, F.lit("+"))),
    }[kind]
    found = places(text, pattern)
    if kind != "email":
        found = F.filter(found, lambda x: _valid(kind, x["value"]))
    spans = F.transform(
        found,
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            x["end"].alias("end"),
            x["value"].alias("value"),
        ),
    )
    return F.when(may, spans).otherwise(F.array().cast(T.ArrayType(SPAN)))


def base_spans(text: Column) -> Column:
    """All base matches of a text (not null), by start, then kind."""
    return F.array_sort(F.concat(*[_spans(text, kind) for kind in KINDS[:4]]))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print"))


def found_in(docs: DataFrame) -> DataFrame:
    """(doc_id, print, base, open): base matches, and the text with blanks in their place."""
    rows = _keyed(docs).withColumn("base", base_spans(F.col("text")))
    return rows.select("doc_id", "print", "base", _blanked(F.col("text"), F.col("base")).alias("open"))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with as many blanks in place of each match, so that places stay."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(so_far: Column, s: Column) -> Column:
        at = F.greatest(so_far["at"], s["start"])
        kept = F.substring(text, so_far["at"] + 1, at - so_far["at"])
        end = F.greatest(at, s["end"])
        parts = F.concat(so_far["parts"], F.array(kept, F.repeat(F.lit(" "), end - at)))
        return F.struct(end.alias("at"), parts.alias("parts"))

    end = lambda x: F.concat(
        F.array_join(x["parts"], ""), F.substring(text, x["at"] + 1, F.length(text))
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, add, end))


def _words(text: Column) -> Column:
    """The words of a text as (start, end, term); pieces end where a word ends and keep the time linear."""

    def of(piece: Column) -> Column:
        return F.transform(
            places(piece["value"], WORD),
            lambda w: F.struct(
                (w["start"] + piece["start"]).alias("start"),
                (w["end"] + piece["start"]).alias("end"),
                F.lower(w["value"]).alias("term"),
            ),
        )

    return F.flatten(F.transform(places(text, PIECE), of))


def _terms(text: Column) -> Column:
    """The distinct words in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))


def _texts(found: DataFrame) -> DataFrame:
    """(print, n, entities, words) of each distinct text with a match; n counts its rows."""
    texts = found.where(F.size("base") > 0).groupBy("print")
    texts = texts.agg(F.count("*").alias("n"), F.first("base").alias("base"), F.first("open").alias("open"))
    entities = F.transform("base", lambda b: F.concat_ws(":", b["kind"], F.lower(b["value"])))
    return texts.select("print", "n", F.array_distinct(entities).alias("entities"), _words(F.col("open")).alias("words"))


def _members(texts: DataFrame, min_texts: int) -> DataFrame:
    """(print, n, subject): whom the terms of a text can reveal.

    Entities that stand in the same texts have the same terms, so they are one subject;
    those of fewer texts than ``min_texts`` are one subject for each kind.
    """
    each = texts.select("print", "n", F.explode("entities").alias("entity"))
    alike = F.sum(F.xxhash64("print").cast("decimal(20,0)"))
    known = each.groupBy("entity").agg(F.count("*").alias("texts"), alike.alias("alike"))
    kind = F.concat(F.lit("kind:"), F.substring_index("entity", ":", 1))
    own = F.concat_ws(":", F.lit("texts"), "texts", "alike")
    named = stored(known.select("entity", F.when(F.col("texts") < min_texts, kind).otherwise(own).alias("subject")))
    return each.join(named, "entity").select("print", "n", "subject").distinct()


def _pairs(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(print, n, subject, term): terms beside a subject; for ``own:`` subjects the words of the entity's value."""
    terms = texts.select("print", F.explode(F.array_distinct("words.term")).alias("term"))
    own = texts.select("print", "n", F.explode("entities").alias("entity"), F.col("words.term").alias("terms"))
    own = own.withColumn("term", F.explode(F.array_intersect(_terms(F.col("entity")), "terms")))
    own = own.select("print", "n", F.concat(F.lit("own:"), "entity").alias("subject"), "term")
    return members.join(terms, "print").unionByName(own)


def revealing(
    found: DataFrame, texts: DataFrame, members: DataFrame, pairs: DataFrame, disclosure: float, min_texts: int
) -> DataFrame:
    """(subject, term): the terms that reveal a subject."""
    together = pairs.groupBy("subject", "term").agg(F.sum("n").alias("both"), F.count("*").alias("texts"))
    together = stored(together.where((F.col("texts") >= min_texts) | F.startswith("subject", F.lit("own:"))))
    own = texts.select("n", F.explode("entities").alias("entity"))
    own = own.where(F.rlike("entity", F.lit(WORD))).select("n", F.concat(F.lit("own:"), "entity").alias("subject"))
    count = members.select("n", "subject").unionByName(own).groupBy("subject").agg(F.sum("n").alias("d_subject"))
    term_count = found.select(F.explode(_terms(F.col("open"))).alias("term")).groupBy("term").agg(F.count("*").alias("d_term"))
    total = found.agg(F.count("*").cast("double").alias("n"))
    # stored, so that adaptive execution can split the terms of a subject
    rated = together.join(stored(count), "subject").join(stored(term_count), "term").crossJoin(F.broadcast(total))  # one row
    told = F.log2(F.col("both") * F.col("n") / (F.col("d_term") * F.col("d_subject")))
    content = F.log2(F.col("n") / F.col("d_subject"))
    sure = ~F.startswith("subject", F.lit("kind:")) | (F.col("both") * content >= EVIDENCE)
    return rated.where((content > 0) & (told >= content * disclosure) & sure).select("subject", "term")


def term_spans(found: DataFrame, disclosure: float, min_texts: int) -> DataFrame:
    """(print, terms): the places of the terms that reveal an entity of the text."""
    texts = stored(_texts(found))
    members = stored(_members(texts, min_texts))
    pairs = _pairs(texts, members)
    chosen = stored(revealing(found, texts, members, pairs, disclosure, min_texts))
    wanted = pairs.join(chosen, ["subject", "term"], "left_semi").select("print", "term").distinct()
    words = texts.select("print", F.explode("words").alias("w")).select("print", "w.term", "w.start", "w.end")
    span = F.struct(
        F.col("start"), F.lit(KINDS.index("term")).alias("kind"), F.col("end"), F.lit("").alias("value")
    )
    return words.join(wanted, ["print", "term"]).groupBy("print").agg(F.collect_list(span).alias("terms"))


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["print"] == right["print"])


def personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """Per row: doc_id, print (a hash of the text), base and all spans (start, kind, end, value)."""
    found = stored(found_in(docs))
    # stored, so that adaptive execution can split the rows of one text
    terms = stored(term_spans(found, disclosure, min_texts))
    out = found.select("doc_id", "print", "base").join(terms, "print", "left")
    every = F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(T.ArrayType(SPAN)))))
    return out.select("doc_id", "print", "base", every.alias("spans"))


def covered(text: Column, spans: Column, generalise: bool) -> Column:
    """The text with each run of spans replaced by the name of its first kind, or removed."""
    names = F.array(*[F.lit(f"[{kind.upper()}]" if generalise else "") for kind in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(so_far: Column, s: Column) -> Column:
        kept = F.substring(text, so_far["at"] + 1, s["start"] - so_far["at"])
        more = F.struct(
            s["end"].alias("at"), F.concat(so_far["parts"], F.array(kept, F.get(names, s["kind"]))).alias("parts")
        )
        inside = F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), so_far["parts"].alias("parts"))
        return F.when(s["start"] >= so_far["at"], more).otherwise(inside)

    end = lambda x: F.concat(
        F.array_join(x["parts"], ""), F.substring(text, x["at"] + 1, F.length(text))
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, add, end))


def sanitised(
    docs: DataFrame, disclosure: float = DISCLOSURE, min_texts: int = MIN_TEXTS, generalise: bool = True
) -> DataFrame:
    """The rows of ``docs`` with personal data and revealing terms replaced in ``text``."""
    # equal rows have equal spans, so one of them is enough to join
    spans = personal_data(docs, disclosure, min_texts).select("doc_id", "print", "spans").where(F.size("spans") > 0)
    spans = spans.groupBy("doc_id", "print").agg(F.first("spans").alias("spans"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"),
                       F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("print"))
    both = rows.join(spans, _same_row(rows, spans), "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(
        covered(F.col("row.text"), F.col("spans"), generalise)
    )
    return both.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
