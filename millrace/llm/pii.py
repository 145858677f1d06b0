"""Personal data, and terms that give it away, in DataFrame operations alone.

Values are found by patterns. A value is a protected entity, and what is known of the
corpus says which terms reveal it: of N documents, n(e) hold the entity e, n(t) the term t,
and n(t, e) both. The information of e is IC = log2(N / n(e)); how much of it t gives away is
PMI(t, e) / IC = 1 - log2(n(t) / n(t, e)) / IC, 1 where t is never without e. In all documents
that hold e, a term above one threshold is generalised, one above a higher threshold removed.
It takes some different texts that hold both to judge a pair, by default wherever in a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.hot_keys import hot_join
from millrace.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# Java patterns that match what these do, leftmost and without overlap, in linear time:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
# A start inside a run of the first class can't match where the run's start doesn't, unless
# a match ended there (\G); nothing follows the last groups, so they never give anything back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text has to have for the pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

NEAR = None
SUPPORT = 2
TERM_LETTERS = 4
GENERALISE = 0.8
REMOVE = 0.95
#: What rounding may take from the disclosure of a pair that just meets a threshold.
ROUNDING = 1e-9

SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
BLOCK = 256
CELL = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """``zero`` and all that values from the first on combine to; one longer than ``values``.

    In blocks, as an array grows by being copied.
    """
    first = F.array(zero)
    grow = lambda acc, v: F.concat(acc, F.array(combine(F.element_at(acc, -1), v)))
    cut = lambda values: F.transform(
        F.sequence(F.lit(0), F.floor(F.size(values) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), first, grow),
    )
    before = lambda blocks: F.aggregate(
        blocks, first, lambda acc, b: F.concat(acc, F.array(combine(F.element_at(acc, -1), F.element_at(b, -1))))
    )
    joined = lambda blocks: F.zip_with(
        blocks,
        before(blocks),
        lambda b, base: F.when(
            b.isNotNull(), F.transform(F.slice(b, 2, F.size(b) - 1), lambda v: combine(base, v))
        ).otherwise(F.slice(first, 1, 0)),
    )
    return F.concat(first, F.flatten(_let(_let(values, cut), joined)))


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of ints."""
    return _let(_running(values, lambda a, b: a + b, F.lit(0)), lambda x: F.slice(x, 2, F.size(x) - 1))


def _cells(text: Column) -> Column:
    """``text`` in pieces of ``CELL`` code points, so that a part of it is found at once."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CELL}}}"), F.lit(0))


def _part(cells: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to before ``end``, from its cells."""
    cell = lambda x: F.floor(x / CELL).cast("int")
    some = F.array_join(F.slice(cells, cell(start) + 1, cell(end - 1) - cell(start) + 1), "")
    return F.when(end > start, F.substr(some, start % CELL + 1, end - start)).otherwise("")


def placed(text: Column, pattern: str, kind: str) -> Column:
    """Every match of ``pattern`` in ``text``: kind, start, end (code points) and value."""

    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        ends = prefix_sums(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)))
        told = F.zip_with(
            found,
            ends,
            lambda m, end: F.struct(
                F.lit(kind).alias("kind"),
                (end - F.length(m)).alias("start"),
                end.alias("end"),
                m.alias("value"),
            ),
        )
        return F.when(F.size(found) > 0, told).otherwise(F.array().cast(SPANS))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    last_first = F.reverse(digits)

    def part(k: Column) -> Column:
        d = F.substr(last_first, k, F.lit(1)).cast("int")
        double = d * 2
        return F.when(k % 2 == 1, d).otherwise(F.when(double > 9, double - 9).otherwise(double))

    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, k: acc + part(k)
    )
    return total % 10 == 0


def _holds(kind: str) -> Callable[[Column], Column]:
    """Whether a match, a span, is one of ``kind``."""

    def holds(span: Column) -> Column:
        value = span["value"]
        if kind == "ip":
            part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
            return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
        digits = F.regexp_replace(value, "[^0-9]", "")
        if kind == "card":
            return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
        if kind == "phone":
            return F.length(digits).between(8, 15)
        return F.lit(True)

    return holds


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, its spans in ``text`` (null: none), by start."""
    text = F.coalesce(text, F.lit(""))
    out = {}
    for kind in KINDS:
        spans = F.filter(placed(text, PATTERNS[kind], kind), _holds(kind))
        if kind in NEEDS:
            none = F.array().cast(SPANS)
            spans = F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none)
        out[kind] = spans
    return out


def _entity(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.lower(span["value"]))


def _words(text: Column, letters: int = TERM_LETTERS) -> Column:
    """The terms of a text: its different words of some letters, each lowered as if alone.

    Of a text lowered whole, words differ from those in place: a dotted capital I becomes two
    characters, one no letter, and a sigma's form depends on what follows the word.
    """
    words = F.filter(F.array_distinct(F.split(text, r"[^\p{L}]+")), lambda w: F.length(w) >= letters)
    return F.array_remove(F.array_distinct(F.split(F.lower(F.array_join(words, " ")), " ")), "")


def _near(cells: Column, spans: Column, near: int, letters: int) -> Column:
    """For each span, its entity and the terms near it (words cut at the rim are left out)."""

    def around(s: Column) -> Column:
        low = F.greatest(F.lit(0), s["start"] - near)
        left = _part(cells, low, s["start"])
        right = _part(cells, s["end"], s["end"] + near)
        left = F.when(low > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
        right = F.when(F.length(right) == near, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
        # A value's own letters aren't terms, so a neighbour that touches it isn't one either.
        terms = _words(F.concat(left, F.lit(" "), right), letters)
        return F.struct(_entity(s).alias("entity"), terms.alias("terms"))

    return F.transform(spans, around)


def _found(docs: DataFrame, text_col: str, carried: Column, keep_texts: bool, name: str) -> DataFrame:
    """``carried, text, h, <kind>..., spans`` of each row, written.

    ``h`` stands for a row's text, and is null, as ``text`` is unless kept, without spans.
    """
    spans = base_spans(F.col("text"))
    rows = docs.select(carried.alias("carried"), F.col(text_col).alias("text")).withColumns(spans)
    rows = rows.withColumn("spans", F.concat(*KINDS)).drop(*KINDS)
    some = F.size("spans") > 0
    return written(
        rows.withColumn("h", F.when(some, F.xxhash64("text"))).withColumn(
            "text", F.col("text") if keep_texts else F.when(some, F.col("text"))
        ),
        name,
    )


def near_terms(found: DataFrame, near: int, letters: int = TERM_LETTERS) -> DataFrame:
    """``row_key, h, entity, term`` for each row, value and term near it in that row."""
    holders = found.where("h is not null")
    parts = holders.withColumn("cells", _cells(F.col("text")))
    around = _near(F.col("cells"), F.col("spans"), near, letters)
    each = parts.select("row_key", "h", F.explode(around).alias("x"))
    return each.select("row_key", "h", "x.entity", F.explode("x.terms").alias("term"))


def judged_terms(pairs: DataFrame, support: int) -> DataFrame:
    """``entity, term`` for those that are near in enough texts."""
    return (
        pairs.groupBy("entity", "term", "h")
        .agg(F.lit(1).alias("one"))
        .groupBy("entity", "term")
        .agg(F.count("*").alias("n_texts"))
        .where(F.col("n_texts") >= support)
        .select("entity", "term")
    )


def _entities(found: DataFrame, letters: int) -> DataFrame:
    """``row_key, entity, copies, n_words, h``: values of each row, and how often the row is there."""
    words = F.size(_words(F.col("text"), letters)).alias("n_words")
    values = F.array_distinct(F.transform("spans", _entity)).alias("values")
    # Beside a generator the words would be counted again for each value.
    rows = found.where("h is not null").select("row_key", "h", words, values)
    each = rows.select("row_key", "h", "n_words", F.explode("values").alias("entity"))
    return each.groupBy("row_key", "entity").agg(
        F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("h").alias("h")
    )


def held_terms(
    found: DataFrame, judged: DataFrame, letters: int = TERM_LETTERS, entities: DataFrame | None = None
) -> DataFrame:
    """``row_key, entity, term, copies`` for each row and pair of ``judged`` that it holds.

    Near or not. Of a row's value, either its judged terms are looked for among the row's
    words or the row's words among them, whichever are fewer; neither is gathered. Rows of
    a value that is on many are dealt to several tasks.
    """
    if entities is None:
        entities = written(_entities(found, letters), "entities")
    n_terms = judged.groupBy("entity").agg(F.count("*").alias("n_terms"))
    on = written(
        entities.groupBy("entity").agg(F.count("*").alias("n")).join(n_terms, "entity"), "on-rows"
    )
    values = hot_join(entities, on.select("entity", "n_terms"), on, ["entity"], "row_key")
    values = written(values, "judged-values")
    holders = found.where("h is not null").join(values.select("row_key").distinct(), "row_key", "left_semi")
    words = holders.select("row_key", F.explode(_words(F.col("text"), letters)).alias("term")).distinct()
    columns = ["row_key", "entity", "term", "copies"]
    by_terms = hot_join(values.where("n_terms <= n_words"), judged, on, ["entity"], "row_key")
    by_terms = by_terms.join(words, ["row_key", "term"], "left_semi").select(*columns)
    own = words.join(values.where("n_terms > n_words").select("row_key", "entity", "copies"), "row_key")
    by_words = hot_join(own, judged, on, ["entity"], "row_key", "left_semi", ("term",)).select(*columns)
    return by_terms.unionByName(by_words)


def disclosing_terms(
    docs: DataFrame,
    found: DataFrame,
    pairs: DataFrame,
    text_col: str,
    support: int,
    generalise: float,
    held: DataFrame | None = None,
    letters: int = TERM_LETTERS,
    entities: DataFrame | None = None,
) -> DataFrame:
    """``entity, term, disclosure`` for each of ``pairs`` of them above the threshold.

    ``held`` is what ``held_terms`` gives for them, if it is there already.
    """
    if entities is None:
        entities = written(_entities(found, letters), "entities")
    if held is None:
        held = held_terms(found, judged_terms(pairs, support), letters, entities)
    n_e = entities.groupBy("entity").agg(F.sum("copies").alias("n_e"))
    together = held.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"))
    return (
        together.join(_everywhere(docs, text_col, letters), "term")
        .join(n_e, "entity")
        .select("entity", "term", _disclosure(docs.count()).alias("disclosure"))
        .where(F.col("disclosure") >= generalise - ROUNDING)
    )


def _everywhere(docs: DataFrame, text_col: str, letters: int) -> DataFrame:
    """``term, n_t``: every document counts; what a task has read is added up before the shuffle."""
    words = _words(F.coalesce(F.col(text_col), F.lit("")), letters)
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def _disclosure(n_docs: int) -> Column:
    ic = F.log2(F.lit(n_docs) / F.col("n_e"))
    shared = F.log2(F.col("n_t") / F.col("n_te"))
    return F.when(ic > 0, 1 - shared / ic).otherwise(0.0)


def _classes(entities: DataFrame, support: int) -> DataFrame:
    """``row_key, h, copies, entity, n_e, n``: values in the same rows are one, named for the first.

    Rows are told apart by 128 bits. A value in fewer texts than ``support`` is on no pair.
    """
    row = F.xxhash64("row_key")
    other = F.xxhash64(F.lit("other"), "row_key")
    of_value = entities.groupBy("entity").agg(
        F.sum(row.cast("decimal(20,0)")).alias("sum"),
        F.bit_xor(other).alias("xor"),
        F.count("*").alias("n"),
        F.sum("copies").alias("n_e"),
    )
    # A value's rows are at least as many as its texts, so this leaves no pair out.
    first = of_value.where(F.col("n") >= support).groupBy("sum", "xor", "n", "n_e").agg(F.min("entity").alias("entity"))
    on = written(first.select("entity", "n", "n_e"), "classes")
    return written(hot_join(entities, on.select("entity", "n_e", "n"), on, ["entity"], "row_key"), "class-rows")


def disclosing_words(
    docs: DataFrame,
    found: DataFrame,
    entities: DataFrame,
    text_col: str,
    support: int,
    generalise: float,
    letters: int = TERM_LETTERS,
) -> DataFrame:
    """``row_key, term, disclosure`` for each row and word that discloses a value of it, the most it does.

    All words of a row are judged for all of its values, near or not. Of a pair, n(t, e) is at
    most n(e), so its disclosure is above the threshold only if
    log2 n(t) <= g log2 n(e) + (1 - g) log2 N; the others are dropped before rows meet values,
    and values that are in the same rows are judged once.
    """
    n_docs = docs.count()
    rows = _classes(entities, support)
    bound = generalise * F.log2("n_e") + (1 - generalise) * F.log2(F.lit(max(n_docs, 1))) + 1e-9
    rows = rows.withColumn("most", bound)
    of_row = rows.groupBy("row_key").agg(F.max("most").alias("row_most"))
    words = found.where("h is not null").select("row_key", F.explode(_words(F.col("text"), letters)).alias("term"))
    words = words.distinct().join(of_row, "row_key")
    counts = written(_everywhere(docs, text_col, letters).where(F.col("n_t") >= support), "terms")
    # A term above the largest bound of all is on no pair; without values there is none.
    largest = of_row.agg(F.max("row_most")).first()[0]
    some = counts.where(F.log2("n_t") <= F.lit(largest))
    few = hot_join(words, some, some.withColumnRenamed("n_t", "n"), ["term"], "row_key")
    few = few.where(F.log2("n_t") <= F.col("row_most")).select("row_key", "term", "n_t")
    held = few.join(rows, "row_key").where(F.log2("n_t") <= F.col("most"))
    held = written(held.select("row_key", "h", "copies", "entity", "term", "n_e", "n_t"), "held")
    told = (
        held.groupBy("entity", "term", "h")
        .agg(F.sum("copies").alias("copies"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
        .groupBy("entity", "term")
        .agg(
            F.count("*").alias("n_texts"),
            F.sum("copies").alias("n_te"),
            F.first("n_e").alias("n_e"),
            F.first("n_t").alias("n_t"),
        )
        .where(F.col("n_texts") >= support)
        .select("entity", "term", _disclosure(n_docs).alias("disclosure"))
        .where(F.col("disclosure") >= generalise - ROUNDING)
    )
    on = written(rows.groupBy("entity").agg(F.count("*").alias("n")), "on-rows")
    return hot_join(held.select("row_key", "entity", "term"), told, on, ["entity"], "row_key", more=("term",)).select(
        "row_key", "term", "disclosure"
    )


def _outside_values(holders: DataFrame, known: DataFrame) -> DataFrame:
    """``row_key, terms``: where the terms of ``known (row_key, term, removed)`` are, by start.

    Those that overlap a value are left out; what lies around a term is found by the order
    of places in its row, so a row with many of both takes no product of them.
    """
    some = holders.join(known.select("row_key").distinct(), "row_key", "left_semi")
    words = some.select("row_key", F.explode(placed(F.col("text"), r"\p{L}+", TERM)).alias("s"))
    words = words.select("row_key", "s.start", "s.end", "s.value", F.lower("s.value").alias("term"))
    terms = words.join(known, ["row_key", "term"]).select("row_key", "start", "end", "value", "removed")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("value", "string"), ("removed", "boolean"))]
    values = some.select("row_key", F.explode("spans").alias("s")).select("row_key", "s.start", "s.end", *none)
    places = terms.unionByName(values).distinct()
    value = F.col("removed").isNull()
    row = Window.partitionBy("row_key")
    onward = row.orderBy("start", F.col("removed").asc_nulls_first(), "end")
    # Both frames grow from one end: one that shrinks is worked out anew for each row.
    backward = row.orderBy(F.desc("start"), F.col("removed").desc_nulls_last(), F.desc("end"))
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (onward, backward))
    placed_ = places.select(
        "*",
        F.max(F.when(value, F.col("end"))).over(before).alias("reached"),
        F.min(F.when(value, F.col("start"))).over(after).alias("next"),
    )
    apart = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (
        F.col("next").isNull() | (F.col("next") >= F.col("end"))
    )
    kind = F.when(F.col("removed"), F.lit("removed")).otherwise(F.lit(TERM)).alias("kind")
    span = F.struct("start", kind, "end", "value")
    in_order = F.transform(
        F.array_sort(F.collect_list(span)), lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"])
    )
    return placed_.where(~value & apart).groupBy("row_key").agg(in_order.cast(SPANS).alias("terms"))


def _protected(
    docs: DataFrame,
    text_col: str,
    carried: Column,
    keep_texts: bool,
    near: int | None,
    support: int,
    generalise: float,
    remove: float,
    letters: int,
) -> DataFrame:
    """``carried, text, spans, terms`` of each row; terms are spans, with ``removed``."""
    found = _found(docs, text_col, carried, keep_texts, "found")
    found = found.withColumn(
        "row_key", F.when(F.col("h").isNotNull(), F.concat_ws(":", F.to_json(F.struct(F.col("carried.id"))), F.hex("h")))
    )
    entities = _entities(found, letters)
    entities = written(entities.drop("n_words") if near is None else entities, "entities")
    if near is None:
        told = disclosing_words(docs, found, entities, text_col, support, generalise, letters)
    else:
        judged = written(judged_terms(near_terms(found, near, letters), support), "judged")
        held = written(held_terms(found, judged, letters, entities), "held")
        of_pair = disclosing_terms(docs, found, judged, text_col, support, generalise, held, letters, entities)
        on = written(entities.groupBy("entity").agg(F.count("*").alias("n")), "on-rows")
        told = hot_join(held, of_pair, on, ["entity"], "row_key", more=("term",))
    known = written(
        told.groupBy("row_key", "term").agg(F.max(F.col("disclosure") >= remove - ROUNDING).alias("removed")), "known"
    )
    holders, others = found.where("h is not null"), found.where("h is null")
    repeated = entities.where("copies > 1").groupBy("row_key").agg(F.max("copies").alias("n"))
    none = F.array().cast(SPANS)
    with_terms = hot_join(
        holders.withColumn("place", F.monotonically_increasing_id()),
        _outside_values(holders, known),
        written(repeated, "repeated"),
        ["row_key"],
        "place",
        "left",
    ).withColumn("terms", F.coalesce("terms", none))
    columns = ["carried", "text", "spans", "terms"]
    return with_terms.select(*columns).unionByName(others.withColumn("terms", none).select(*columns))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    near: int | None = NEAR,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    letters: int = TERM_LETTERS,
) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of each row.

    Counts are of the values of each kind. ``base_sha256`` is the digest (hex) of their
    ``kind:start:end``, by kind in this order and start, joined by commas; ``spans`` holds
    the same and after them the disclosing terms (kind ``term``). Places are code points
    from 0, the end exclusive.

    Terms are words of at least ``letters`` letters, without case; all those of the texts that
    hold a value are judged for it, if at least ``support`` different texts hold both. With
    ``near``, only those are that stand within so many code points of the value in as many
    texts. Those that disclose it are spans wherever they are in a row that holds the value.
    Statistics are over all rows. A null or empty text has no spans; repeated rows
    count as documents and are each reported, rows of a null id too; no rows give none.
    """
    rows = _protected(
        docs, text_col, F.struct(F.col(id_col).alias("id")), False, near, support, generalise, remove, letters
    )
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    as_term = F.transform("terms", lambda s: s.withField("kind", F.lit(TERM)))
    return rows.select(
        F.col("carried.id").alias("doc_id"),
        *(of(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"),
        _joined(F.concat("spans", as_term)).alias("spans"),
    )


def sanitise(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    near: int | None = NEAR,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    letters: int = TERM_LETTERS,
) -> DataFrame:
    """``docs`` with values and terms of ``find_personal_data`` taken out of ``text_col``.

    A value becomes its kind in capitals in brackets, as ``[EMAIL]``; values that overlap
    become one, named for the first. A term is generalised to ``[TERM]`` or removed. Other
    columns, and rows without values, stay as they are, so a null or empty text stays null or
    empty. Repeated rows and rows of a null id are each cleaned alike, and count as documents.
    No rows give none.
    """
    whole = F.struct(F.col(id_col).alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = _protected(docs, text_col, whole, True, near, support, generalise, remove, letters)
    ordered = F.array_sort(
        F.transform(
            F.concat("spans", "terms"),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    def told(kind: Column) -> Column:
        return F.when(kind == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))

    rows = rows.select("carried", "text", ordered.alias("ordered"), _cells(F.col("text")).alias("cells"))
    ends = F.transform("ordered", lambda s: s["end"])
    reached = _running(ends, lambda a, b: F.greatest(a, b), F.lit(0))  # one longer than ends
    rows = rows.withColumn("reached", reached)
    cells = F.col("cells")
    pieces = F.zip_with(
        F.col("ordered"),
        F.slice("reached", 1, F.size("ordered")),
        lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(
            F.concat(_part(cells, at, s["start"]), told(s["kind"]))
        ),
    )
    tail = _part(cells, F.element_at("reached", -1), F.length("text"))
    text = F.when(F.size("ordered") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    columns = [
        (text if c == text_col else F.col("carried.row")[c]).alias(c) for c in docs.columns
    ]
    return rows.select(*columns)
