"""Operator 12: personal data, and terms that give it away, in DataFrame operations only.

Base spans (e-mail and IP addresses, card and phone numbers) come from patterns. Around them
the corpus is asked how much each term reveals: for a term t that stands near a protected
entity e (a value of a base span), the point-wise mutual information of the two over what the
entity itself says, PMI(t; e) / IC(e) = 1 + log(p(e near t | t)) / IC(e), is the share of the
entity's information that the term discloses. In the documents that hold the entity, terms
beyond the threshold are spans too: they are generalised to their first letters where these
stay below the threshold, or removed.

Texts are read twice, for spans with the words around them and for the words' document
frequencies; everything else works on narrow tables. Positions come from the lengths of what
a pattern splits a text into, by prefix sums over blocks, so that long texts stay cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import stored

# The patterns with possessive quantifiers, and begins only where one can succeed (behind no
# character that could begin the match, or where the last match ended): the same matches
# without trying every place of a long run.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_LETTERS, _WORD = r"\p{L}++", r"\p{L}{3,}+"

THRESHOLD = 0.9  # share of an entity's information that a term may disclose
NEAR = 4  # words on each side of a span whose co-occurrence counts
REACH = 160  # characters on each side within which they are looked for
BEGIN = 3  # letters that a generalised term keeps


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prefix(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The running sum (or other ``merge`` with 0 as its zero) of an array, in blocks of the root
    of its length, so that the work is n times that root and not n squared."""
    zero = F.lit(0)

    def fold(x: Column, start, n) -> Column:
        return F.aggregate(F.slice(x, start, n), zero, merge)

    def blocked(x: Column, width: Column) -> Column:
        blocks = F.transform(F.sequence(zero, F.size(x) - 1, width), lambda b: fold(x, b + 1, width))
        return _let(blocks, lambda t: _let(F.transform(t, lambda _, k: F.when(k == 0, zero).otherwise(fold(t, F.lit(1), k))), lambda before: spread(x, width, before)))

    def spread(x: Column, width: Column, before: Column) -> Column:
        def block(upto: Column, k: Column) -> Column:
            begin = k * width
            return F.transform(F.sequence(F.lit(1), F.least(width, F.size(x) - begin)), lambda r: merge(upto, fold(x, begin + 1, r)))

        return F.flatten(F.transform(before, block))

    def rooted(x: Column) -> Column:
        return _let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda width: blocked(x, width))

    return _let(values, lambda x: F.when(F.size(x) > 0, rooted(x)).otherwise(F.array().cast("array<int>")))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _matches(text: Column, pattern: str, made: Callable[[Column, Column, Column, Column], Column], none: Column) -> Column:
    """``made(match, start, gap before, gap behind)`` for each match of ``pattern``."""

    def placed(found: Column, gaps: Column) -> Column:
        sizes = F.transform(found, F.char_length)
        steps = _let(sizes, lambda m: F.transform(found, lambda _, i: F.char_length(F.get(gaps, i)) + F.when(i == 0, 0).otherwise(F.get(m, i - 1))))
        return _let(_prefix(steps, _sum), lambda starts: F.transform(found, lambda v, i: made(v, F.get(starts, i), F.get(gaps, i), F.get(gaps, i + 1))))

    def split(found: Column) -> Column:
        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), split)


def _words(window: Column, cut: Column, last: bool) -> Column:
    """The NEAR words of a window that are closest to its span, in lower case; where the window
    was ``cut`` out of a longer gap, its outermost word may be a part and doesn't count."""

    def closest(words: Column) -> Column:
        n = F.least(F.lit(NEAR), F.size(words) - cut.cast("int"))
        taken = F.slice(words, F.size(words) - n + 1, n) if last else F.slice(words, F.lit(1), n)
        return F.filter(F.transform(F.when(n > 0, taken).otherwise(F.array().cast("array<string>")), F.lower), lambda w: F.char_length(w) >= 3)

    return _let(F.regexp_extract_all(window, F.lit(_LETTERS), F.lit(0)), closest)


def _valid(kind: str, value: Column) -> Column:
    """Whether a match counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    size = F.char_length(digits)
    return size.between(13, 19) & F.call_function("luhn_check", digits) if kind == "card" else size.between(9, 15)


def _entity(kind: str, value: Column) -> Column:
    """The value in one spelling."""
    if kind in ("card", "phone"):
        value = F.regexp_replace(value, "[^0-9]", "")
    return F.concat(F.lit(f"{kind}:"), F.lower(value))


_PLACE = "struct<term:string,start:int,end:int>"
_SPAN = "struct<kind:string,start:int,end:int,entity:string,terms:array<string>>"


def _base(text: Column) -> Column:
    """The base spans of a text with the words near each."""

    def of_kind(kind: str) -> Column:
        def made(value: Column, start: Column, before: Column, behind: Column) -> Column:
            left = _words(F.right(before, F.lit(REACH)), F.char_length(before) > REACH, True)
            right = _words(F.substring(behind, 1, REACH), F.char_length(behind) > REACH, False)
            span = F.struct(
                F.lit(kind).alias("kind"),
                start.cast("int").alias("start"),
                (start + F.char_length(value)).cast("int").alias("end"),
                _entity(kind, value).alias("entity"),
                F.array_distinct(F.concat(left, right)).alias("terms"),
            )
            return F.when(_valid(kind, value), span)

        none = F.array().cast(f"array<{_SPAN}>")
        found = F.filter(_matches(text, PATTERNS[kind], made, none), lambda s: s.isNotNull())
        mark = {"email": "@", "phone": "+"}.get(kind)
        return F.when(F.contains(text, F.lit(mark)), found).otherwise(none) if mark else found

    return F.concat(*map(of_kind, PATTERNS))


def _places(text: Column) -> Column:
    """Every word of three letters or more, and where it stands."""

    def made(value: Column, start: Column, before: Column, behind: Column) -> Column:
        return F.struct(F.lower(value).alias("term"), start.cast("int").alias("start"), (start + F.char_length(value)).cast("int").alias("end"))

    return _matches(text, _WORD, made, F.array().cast(f"array<{_PLACE}>"))


def _disclosing(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(entity, term, general): the terms that disclose more of an entity than the threshold
    allows; ``general`` is their begin if it discloses less, else null."""
    of_doc = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.transform(s["terms"], lambda t: F.struct(s["entity"].alias("entity"), t.alias("term"))))))
    together = rows.select(F.explode(of_doc).alias("pair")).groupBy("pair.entity", "pair.term").agg(F.count("*").alias("both"))
    entities = rows.select(F.explode(F.array_distinct(F.transform("spans", lambda s: s["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("holders"))
    all_docs = rows.agg(F.count("*")).first()[0]
    # a word counts once a document, before the shuffle
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.lower))
    frequency = stored(texts.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("docs")), "words")
    # a begin is in as many documents as its most frequent word, at least
    begins = frequency.groupBy(F.substring("term", 1, BEGIN).alias("begin")).agg(F.max("docs").alias("begin_docs"))
    information = F.log2(F.lit(float(max(all_docs, 1))) / F.col("holders"))
    pairs = (
        together.join(entities, "entity")
        .where(F.lit(all_docs) > F.col("holders"))  # what every document holds is no secret
        .join(frequency, "term")
        .where(1 + F.log2(F.col("both") / F.col("docs")) / information >= threshold)
        .withColumn("begin", F.substring("term", 1, BEGIN))
        .join(begins, "begin")
    )
    safe = (F.char_length("term") > BEGIN) & (1 + F.log2(F.least(F.col("holders") / F.col("begin_docs"), F.lit(1.0))) / information < threshold)
    return pairs.select("entity", "term", F.when(safe, F.concat("begin", F.lit("*"))).alias("general"))


_KEY = ["k1", "k2", "id"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a key of the id and the text: rows that share it have equal results."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("second"), text), "id": F.coalesce(docs[id_col].cast("string"), F.lit(""))})


def _found(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, id, doc_id, spans, terms) for each row: base spans, and term spans with what
    stands for each."""
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    keyed = _keyed(plain, "doc_id", "text")
    # the words of texts with spans are kept with their places, so that texts are not read again for them
    places = F.when(F.size("spans") > 0, _places(F.col("text"))).otherwise(F.array().cast(f"array<{_PLACE}>"))
    rows = stored(keyed.withColumn("spans", _base(F.col("text"))).select(*_KEY, "doc_id", "spans", places.alias("places")), "spans")
    known = _disclosing(rows, plain, threshold)
    held = rows.where(F.size("spans") > 0).select(*_KEY, F.explode(F.array_distinct(F.transform("spans", lambda s: s["entity"]))).alias("entity")).distinct()
    # terms of a document's own entities; where one reveals several of them, removing wins
    secret = (
        held.join(known, "entity")
        .groupBy(*_KEY, "term")
        .agg(F.when(F.bool_or(F.col("general").isNull()), None).otherwise(F.max("general")).alias("general"))
        .groupBy(*_KEY)
        .agg(F.map_from_entries(F.collect_list(F.struct("term", F.coalesce("general", F.lit(""))))).alias("secret"))
    )

    def alone(m: Column) -> Column:
        return ~F.exists("spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))

    places = F.filter("places", lambda m: F.map_contains_key("secret", m["term"]) & alone(m))
    term = F.transform(places, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.element_at("secret", m["term"]).alias("general")))
    none = F.array().cast("array<struct<start:int,end:int,general:string>>")
    out = rows.join(secret, _KEY, "left").withColumn("terms", F.when(F.col("secret").isNull(), none).otherwise(term))
    return out.select(*_KEY, "doc_id", "spans", "terms")


def personal_data(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, terms) for each row of ``docs``.

    ``spans`` lists (kind, start, end, entity) of e-mail addresses, IP addresses, card and
    phone numbers, kind by kind, each leftmost and without overlaps within its kind; matches
    that fail their kind's test are dropped. ``terms`` lists (start, end, general) of the
    terms outside of them that disclose one of the document's own entities: words of three
    letters or more that stand within four words of it in some document and share so much of
    their documents with it that the disclosed share of its information reaches
    ``threshold``. ``general`` is what may stay of the term, '' for nothing. Places are in code points,
    ends exclusive.

    A null or empty text has no spans. Rows that repeat an id or a text are documents of their
    own in all counts; null ids stay null. Other columns are not read; an empty table gives
    an empty result."""
    out = _found(docs, threshold, id_col, text_col)
    return out.select("doc_id", F.transform("spans", lambda s: s.dropFields("terms")).alias("spans"), "terms")


def sanitise(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``personal_data`` taken out of the text: base spans become
    ``<kind>``, terms what is left of them. Null texts stay null; all other columns stay."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = dict(zip(names, inner, strict=True))
    numbered = docs.toDF(*inner)
    found = _found(numbered, threshold, at[id_col], at[text_col]).where("size(spans) + size(terms) > 0").dropDuplicates(_KEY).drop("doc_id")
    joined = _keyed(numbered, at[id_col], at[text_col]).join(found, _KEY, "left")
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), s["kind"], F.lit(">")).alias("into")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["general"].alias("into")))
    text, size = F.col(at[text_col]), 256

    def rebuilt(cuts: Column, blocks: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / size).cast("int")
            own = F.array_join(F.slice(blocks, first + 1, F.floor(b / size).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(own, a - first * size + 1, b - a)).otherwise("")

        def pieces(done: Column) -> Column:  # done: how far the text is covered behind each cut
            def piece(c: Column, i: Column) -> Column:
                upto = F.when(i == 0, 0).otherwise(F.get(done, i - 1))
                return F.when(c["start"] >= upto, F.concat(between(upto, c["start"]), c["into"])).otherwise("")

            tail = between(F.element_at(done, -1), F.char_length(text))
            return F.concat(F.array_join(F.transform(cuts, piece), ""), tail)

        return _let(_prefix(F.transform(cuts, lambda c: c["end"]), _most), pieces)

    whole = _let(F.array_sort(F.concat(base, terms)), lambda cuts: _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}+"), F.lit(0)), lambda blocks: rebuilt(cuts, blocks)))
    cleaned = joined.withColumn(at[text_col], F.when(F.col("spans").isNull(), text).otherwise(whole))
    return cleaned.select(*(F.col(at[c]).alias(c) for c in names))


def digests(found: DataFrame) -> DataFrame:
    """Counts and lists of spans as text: ``kind:start:end``, joined by commas."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    return found.select("doc_id", *map(count, PATTERNS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))
