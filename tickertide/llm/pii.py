"""Personal data in texts: fixed formats, and identifiers found by bootstrapped contexts.

Everything here is DataFrame operations. A text is scanned once; what leaves the scan are
the matches, the lengths of the gaps between them, and the words before them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickertide.llm.tables import stage

KINDS = ["email", "ip", "card", "phone"]

# A separator between two characters that it may join is turned into MARK, of the same length.
# That makes each format a run of one character class: no regex recursion on long runs, and
# possessive runs that begin at a boundary take linear time on any text.
MARK, OTHER = "\u0001", "\u0002"
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{MARK}{LOCAL}]))[{MARK}{LOCAL}]++@[A-Za-z0-9-]++{MARK}[{MARK}A-Za-z0-9-]++"
DOTS = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{MARK}]++"
JOINTS = r"(?<=[0-9])[ -](?=[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
SPACE = r"\x20\x09-\x0D"
#: A word with a digit or an at sign.
CANDIDATE = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
#: Sixteen digits that separators may join: what a card needs at least.
LONG_NUMBER = r"[0-9](?:[ -]?[0-9]){15}"


def _none() -> Column:
    return F.array().cast("array<string>")


def _matches(text: Column, regex: str, may: Column) -> Column:
    return F.when(may, F.regexp_extract_all(text, F.lit(regex), F.lit(0))).otherwise(_none())


def _gaps(text: Column, regex: str, found: str) -> Column:
    return F.when(F.size(found) > 0, F.split(text, regex, -1)).otherwise(_none())


def _scan(docs: DataFrame) -> DataFrame:
    """Per row: its place, doc_id, and each match with the length of the gap before it."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    numbers = F.col("raw").rlike("[0-9@]")
    marked = F.translate("raw", MARK, OTHER)
    rows = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("text_key"), raw.alias("raw")
    ).select(
        "doc_id",
        "row",
        "text_key",
        "raw",
        F.when(F.col("raw").contains("@"), F.regexp_replace(marked, DOTS, MARK)).alias("dotted"),
        F.when(F.col("raw").rlike(LONG_NUMBER), F.regexp_replace(marked, JOINTS, MARK)).alias("joint"),
    )
    sources = {
        "email": (F.col("dotted"), EMAIL, F.col("dotted").isNotNull()),
        "ip": (F.col("raw"), IP, F.col("raw").rlike(r"[0-9]\.[0-9]")),
        "card": (F.col("joint"), CARD, F.col("joint").isNotNull()),
        "phone": (F.col("raw"), PHONE, F.col("raw").contains("+")),
        "other": (F.col("raw"), CANDIDATE, numbers),
    }
    found = rows.select(
        "doc_id", "row", "text_key", "raw", "dotted", "joint", *(_matches(*sources[k]).alias(k) for k in sources)
    )
    gapped = found.select(
        "doc_id", "row", "text_key", *sources, *(_gaps(t, r, k).alias(f"{k}_gaps") for k, (t, r, _) in sources.items())
    )
    blank = "\t\n\x0b\f\r"

    def before(gap: Column) -> tuple[Column, Column]:
        words = F.rtrim(F.translate(F.lower(gap), blank, " " * len(blank)))
        return F.substring_index(words, " ", -1), F.substring_index(words, " ", -2)

    def items(kind: str) -> Column:
        def item(hit: Column, i: Column) -> Column:
            gap = F.get(F.col(f"{kind}_gaps"), i)
            one, two = before(gap) if kind == "other" else (F.lit(None), F.lit(None))
            return F.struct(
                F.lit(kind).alias("kind"),
                i.alias("at"),
                F.length(gap).alias("gap"),
                hit.alias("hit"),
                one.cast("string").alias("one"),
                two.cast("string").alias("two"),
            )

        return F.transform(kind, item)

    return stage(gapped.select("doc_id", "row", "text_key", F.concat(*map(items, sources)).alias("items")), "pii-scan")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid() -> Column:
    hit, kind = F.col("hit"), F.col("kind")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small_parts = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    return (
        F.when(kind == "ip", small_parts)
        .when(kind == "card", F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(True)
    )


def _bootstrap(edges: DataFrame, rounds: int, least: float, support: int) -> DataFrame:
    """Contexts that announce a kind of identifier: rows (context, kind).

    ``edges`` are (context, instance, kind, n): how often an instance follows a context; kind is
    null for an instance that no format knows. A context scores the mean score of what follows
    it, with one unknown added; an unknown instance scores as its best context, a known one 1.
    """
    known = edges.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    totals = edges.groupBy("context").agg(F.sum("n").alias("total"))
    plain = edges.groupBy("context", "instance").agg(F.sum("n").alias("n"))
    edges, totals = stage(plain, "pii-edges"), stage(totals, "pii-totals")
    known = stage(known, "pii-known")
    unknown = edges.join(known.select("instance").distinct(), "instance", "left_anti")
    scores = known
    patterns = None
    for _ in range(rounds):
        weighed = (
            edges.join(scores, "instance")
            .groupBy("context", "kind")
            .agg(
                F.sum(F.col("n") * F.col("score")).alias("good"),
                F.sum(F.when(F.col("score") == 1, 1).otherwise(0)).alias("seeds"),
            )
            .where(F.col("seeds") >= support)
        )
        patterns = stage(
            weighed.join(totals, "context")
            .select("context", "kind", (F.col("good") / (F.col("total") + 1)).alias("score"))
            .where(F.col("score") >= least),
            "pii-patterns",
        )
        grown = unknown.join(patterns, "context").groupBy("instance", "kind").agg(F.max("score").alias("score"))
        scores = stage(known.unionByName(grown), "pii-scores")
    best = patterns.groupBy("context").agg(F.max(F.struct("score", "kind")).alias("b"))
    return best.select("context", "b.kind")


def find_spans(
    docs: DataFrame, rounds: int = 3, least: float = 0.6, support: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, text_key) of ``docs``, and spans (row, kind, start, stop, base) in code points.

    A span with ``base`` matches a format. The others are words with a digit or an at sign
    that follow a context of one or two words; at least ``support`` known identifiers of a
    kind follow it, and its share of identifiers reaches ``least`` after ``rounds`` rounds.
    """
    scan = _scan(docs)
    rows = scan.select("row", F.explode("items").alias("i")).select("row", "i.*")
    inside = Window.partitionBy("row", "kind").orderBy("at")
    upto = F.sum(F.col("gap") + F.length("hit")).over(inside)
    placed = rows.select("row", "kind", "hit", "one", "two", upto.alias("stop"))
    placed = placed.withColumn("start", F.col("stop") - F.length("hit"))
    placed = stage(placed.where((F.col("kind") == "other") | _valid()), "pii-places")

    # What a candidate has to do with the formats: begun by one, inside of one, or free.
    is_base = F.col("kind") != "other"
    ordered = Window.partitionBy("row").orderBy("start", is_base).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc(is_base)).rowsBetween(Window.unboundedPreceding, -1)
    base = F.when(is_base, F.struct("start", "kind", "hit"))
    around = placed.select(
        "*",
        F.max(F.when(is_base, F.col("stop"))).over(ordered).alias("covered"),
        F.last(base, ignorenulls=True).over(back).alias("next"),
    )
    free = around.where(~is_base).where(F.coalesce(F.col("covered"), F.lit(0)) <= F.col("start"))
    begun = F.when(F.col("next.start") < F.col("stop"), F.col("next.kind"))  # in the word, or with it
    trimmed = F.regexp_replace("hit", r"[^A-Za-z0-9]+$", "")
    words = stage(
        free.select(
            "row",
            (F.col("stop") - F.length("hit") + F.length(trimmed)).alias("stop"),
            "start",
            F.lower(F.when(begun.isNotNull(), F.col("next.hit")).otherwise(trimmed)).alias("instance"),
            begun.alias("kind"),
            F.array_distinct(F.array("one", "two")).alias("contexts"),
        ).where(F.length(trimmed) > 0),
        "pii-words",
    )
    linked = words.select("*", F.explode("contexts").alias("context")).where(F.col("context").rlike(r"\p{L}"))
    edges = linked.groupBy("context", "instance", "kind").agg(F.count("*").alias("n"))
    patterns = _bootstrap(edges, rounds, least, support)
    found = (
        linked.where("kind is null")
        .drop("kind")
        .join(patterns, "context")
        .groupBy("row", "start", "stop")
        .agg(F.max("kind").alias("kind"))
        .select("row", "kind", "start", "stop", F.lit(False).alias("base"))
    )
    spans = placed.where(is_base).select("row", "kind", "start", "stop", F.lit(True).alias("base")).unionByName(found)
    return scan.select("doc_id", "row", "text_key"), spans


def personal_data(docs: DataFrame, **limits) -> DataFrame:
    """Personal data in ``docs`` (doc_id, text): counts and digest of the formats, all spans.

    Null texts count as empty. Each input row gives one row, also for repeated rows; other
    columns are ignored. A table in which no format occurs has no contexts and no spans.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.
    """
    rows, spans = find_spans(docs, **limits)
    order = reduce(lambda c, i: c.when(F.col("kind") == KINDS[i], i), range(1, 4), F.when(F.col("kind") == KINDS[0], 0))
    name = F.concat_ws(":", "kind", "start", "stop")
    listed = F.struct(order.alias("order"), "start", "stop", name.alias("name"))
    per_row = spans.groupBy("row").agg(
        *(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS),
        F.array_sort(F.collect_list(F.when(F.col("base"), listed))).alias("base"),
        F.array_sort(F.collect_list(listed)).alias("all"),
    )

    def joined(column: str) -> Column:
        names = F.transform(F.coalesce(column, F.array().cast(f"array<{item}>")), lambda s: s["name"])
        return F.array_join(names, ",")

    item = per_row.schema["all"].dataType.elementType.simpleString()
    return rows.join(per_row, "row", "left").select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("all").alias("spans"),
    )


def mask_personal_data(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in brackets, and the new length
    in n_chars if there is such a column. Rows of the same doc_id and text are masked alike;
    null texts stay null, and other columns stay as they are, whatever their names."""
    rows, spans = find_spans(docs, **limits)
    per_row = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "kind"))).alias("spans"))
    marks = stage(
        rows.join(per_row, "row").select(F.col("doc_id").alias("m_doc"), "text_key", "spans").distinct(), "pii-marks"
    )
    text = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def put(done: Column, span: Column) -> Column:
        kept = F.substring(text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        fresh = F.struct(
            F.concat(done["out"], kept, F.lit("["), F.upper(span["kind"]), F.lit("]")).alias("out"),
            span["stop"].alias("at"),
        )
        longer = F.struct(done["out"].alias("out"), F.greatest(done["at"], span["stop"]).alias("at"))
        return F.when(span["start"] >= done["at"], fresh).otherwise(longer)

    masked = F.aggregate(
        "spans", start, put, lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.length(text)))
    )
    # Columns of the documents stay inside a struct, so that none meets a name used here.
    held = docs.select(F.struct("*").alias("doc")).withColumn("text", F.col("doc.text"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("m_doc")) & (F.xxhash64("text") == F.col("text_key"))
    new = F.when(F.col("spans").isNotNull(), masked).otherwise(text)
    joined = held.join(marks, same, "left").select("doc", new.alias("new_text"))
    changed = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return joined.select(*(changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))
