"""Operator 10: personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap: the strict base
kinds (email, ip, card, phone) and loose ones (spelled-out addresses, digit
groups, identity numbers, account numbers, key-like tokens).  Base spans that pass
their checks stay.  Every other candidate is scored by boosted trees on format and
context features.  Two things label the candidates that they learn from: the checks
of the base kinds, and for key-like tokens whether a word for a secret names them.
Each loose kind has a threshold of its own, from labelled candidates of the kind
nearest in form (``LIKE``) that training does not see: the smallest score that
reaches ``PRECISION`` there.

Everything is DataFrame functions and MLlib.  One scan turns texts into rows of
candidates with a few context characters (texts are not shuffled); places come
from running sums over a document's candidates, so no array grows with the
square of a document's matches.  The trees are fitted on at most ``TRAIN_ROWS``
candidates with the smallest hashes; calibration reads counts per score step.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.common import boxed, prepared, unboxed

CONTEXT = 24                  # characters kept on either side of a candidate
TRAIN_ROWS = 20_000
ROUNDS, DEPTH = 10, 3
STEPS = 100                   # score steps of the calibration
PRECISION = 0.98

# Base kinds in the order of the result.  Each pattern finds what the plain form
# in its comment finds, without backtracking over long runs.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Loose kinds and their patterns.
LOOSE = {
    "email_spelled": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?|@)[A-Za-z0-9-]++"
                     r"(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]++)++",
    "digit_groups": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z.-])",
    "identity": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![0-9A-Za-z])",
    # at least 20 characters with letters and digits among them
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+",
}
# The labelled kind whose held-out candidates give a loose kind its threshold.
LIKE = {"email_spelled": "email", "digit_groups": "phone", "identity": "card", "account": "card", "secret": "secret"}
# What stands right before a named secret.
SECRET_NAME = r"(?i)(?:token|secret|key|passw(?:or)?d|passwd|bearer|auth)[\x20_a-z]{0,8}[\x20=:\"'`]{1,5}$"
PATTERNS = BASE | LOOSE
# What every match of a kind holds, and every match of any kind.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "email_spelled": r"@|[\[(]at[\])]",
         "digit_groups": "[0-9]{2}", "identity": "[0-9]{3}-[0-9]{2}-", "account": "[A-Z]{2}[0-9]{2}",
         "secret": "[A-Za-z0-9_+/-]{20}"}
ANY_SIGN = r"[0-9@]|[\[(]at[\])]"
# Words that often stand before personal data.
CONTEXT_WORDS = r"(?i)\b(?:call|phone|tel|fax|mobile|mail|email|contact|write|ssn|iban|account|card|passport|id|ip)\b"
FEATURES = ("length", "digits", "letters", "spaces", "dashes", "dots", "ats", "plus", "groups", "last_group",
            "before_letter", "before_space", "after_letter", "after_space", "after_digit", "named", "switches", "assigned")


def _structs(kind: str) -> Column:
    """Array of one kind's candidates, from its matches and the gaps around them."""
    matches, gaps = F.col(f"m_{kind}"), F.col(f"g_{kind}")

    def one(x, i):
        return F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.char_length(x["g"]).cast("long").alias("gap"),
                        x["m"].alias("match"), F.right(x["g"], F.lit(CONTEXT)).alias("before"),
                        F.left(x["h"], F.lit(CONTEXT)).alias("after"))
    return F.transform(F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g"),
                                    F.slice(gaps, 2, F.size(matches)).alias("h")), one)


def candidates(rows: DataFrame) -> DataFrame:
    """Rows (rid, doc_id, kind, nth, gap, match, before, after), one per candidate of any kind in ``text``.

    ``gap`` counts the characters between the previous match of the kind and this
    one.  A row without candidates stays, with a null kind.  A kind is looked
    for only in texts that hold the signs every match of it has (``SIGNS``).
    """
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = rows.select("rid", "doc_id", F.when(whole.rlike(ANY_SIGN), whole).otherwise("").alias("whole"))
    texts = texts.select("rid", "doc_id", *[F.when(F.col("whole").rlike(SIGNS[k]), F.col("whole")).otherwise("")
                                            .alias(f"t_{k}") for k in PATTERNS])
    cut = texts.select("rid", "doc_id", *[x for k, p in PATTERNS.items() for x in (
        F.regexp_extract_all(f"t_{k}", F.lit(p), F.lit(0)).alias(f"m_{k}"), F.split(f"t_{k}", p, -1).alias(f"g_{k}"))])
    found = F.concat(*[_structs(kind) for kind in PATTERNS])
    return cut.select("rid", "doc_id", F.explode_outer(found).alias("c")).select("rid", "doc_id", "c.*")


def _luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
        F.coalesce(d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0), F.lit(0))))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    """Whether a base candidate passes the check of its kind."""
    digits = F.regexp_replace(match, r"[^0-9]", "")
    n = F.length(digits)
    parts = F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, r"^0+(?=[0-9])", "")) <= 3)
                     & (F.right(p, F.lit(3)).try_cast("int") <= 255))
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", parts) \
        .when(kind == "card", F.when(n.between(16, 19), _luhn(F.when(n.between(16, 19), digits).otherwise("0")))
              .otherwise(False)) \
        .when(kind == "phone", n.between(8, 15)).otherwise(F.lit(False))


def feature_columns() -> list[Column]:
    """Format and context of a candidate."""
    m, before, after = F.col("match"), F.col("before"), F.col("after")

    def count(pattern):
        return F.regexp_count(m, F.lit(pattern)).cast("double")

    def flag(x):
        return F.coalesce(x, F.lit(False)).cast("double")
    values = [F.char_length(m).cast("double"), count("[0-9]"), count("[A-Za-z]"), count(r"\x20"), count("-"), count(r"\."),
              count("@"), flag(m.startswith("+")), count("[0-9]++"),
              F.char_length(F.regexp_extract(m, "[0-9]*$", 0)).cast("double"),
              flag(before.rlike(r"\p{L}$")), flag(before.rlike(r"(?:\s|^)$")), flag(after.rlike(r"^\p{L}")),
              flag(after.rlike(r"^(?:\s|[.,;]\s|$)")), flag(after.rlike(r"^[0-9]")), flag(before.rlike(CONTEXT_WORDS)),
              count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), flag(before.rlike(SECRET_NAME))]
    return [v.alias(n) for v, n in zip(values, FEATURES)]


def _model(labelled: DataFrame):
    """Boosted trees on a bounded number of labelled candidates; None without both labels."""
    rows = labelled.where(F.col("fold") != 0) \
        .orderBy("hash").limit(TRAIN_ROWS).checkpoint(eager=True)
    if rows.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)
    return GBTClassifier(featuresCol="x", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, seed=5,
                         cacheNodeIds=False).fit(vectors)


def _scored(model, rows: DataFrame) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)
    return model.transform(vectors).withColumn("score", vector_to_array("probability")[1]) \
        .drop("x", "rawPrediction", "probability", "prediction")


def _thresholds(scored: DataFrame) -> dict[str, float]:
    """Per loose kind the smallest score step with ``PRECISION`` among the held-out candidates of the kind like it.

    All kinds' candidates stand in where that kind has none; 2 (nothing passes) without any.
    """
    counts = scored.where("fold = 0").groupBy("kind", F.floor(F.col("score") * STEPS).cast("int").alias("step")) \
        .agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()  # at most STEPS + 1 rows a kind
    out = {}
    for loose, like in LIKE.items():
        own = [r for r in counts if r["kind"] == like] or ([r for r in counts if r["kind"] in BASE] if like in BASE else [])
        good = total = 0
        out[loose] = 2.0
        for r in sorted(own, key=lambda r: -r["step"]):
            good, total = good + r["good"], total + r["n"]
            if good >= PRECISION * total:
                out[loose] = r["step"] / STEPS
    return out


def spans(found: DataFrame) -> DataFrame:
    """All accepted spans among the candidates ``found``: rid, doc_id, kind, is_base, start, end, reach.

    ``reach`` is the largest end of the spans before.  Each rid also has one row
    with a null kind, with or without spans.
    """
    found = found.withColumn("base_ok", passes(F.col("kind"), F.col("match"))).checkpoint(eager=True)
    order = Window.partitionBy("rid", "kind").orderBy("nth")
    ends = F.sum(F.col("gap") + F.char_length("match")).over(order)
    placed = found.where("kind IS NOT NULL").withColumn("end", ends) \
        .withColumn("start", F.col("end") - F.char_length("match"))
    is_base = F.col("kind").isin(*BASE)
    featured = placed.select("*", *feature_columns())
    # The checks label the base candidates, and the trees learn from these.  A failing one that has the
    # form of a loose kind says nothing (a checksum for cards is no verdict on other numbers).
    other = F.lit(False)
    for pattern in LOOSE.values():
        other = other | F.col("match").rlike(f"^(?:{pattern})$")
    label = F.when(is_base, F.col("base_ok")).otherwise(F.col("before").rlike(SECRET_NAME))
    labelled = featured.where(F.when(is_base, F.col("base_ok") | ~other).otherwise(F.col("kind") == "secret")).select(
        "kind", *FEATURES, label.cast("double").alias("label"), F.xxhash64("match", "before", "after").alias("hash")) \
        .withColumn("fold", F.pmod(F.col("hash"), F.lit(5)))
    model = _model(labelled)
    names = ["rid", "doc_id", "kind"]
    keep = placed.where(is_base & F.col("base_ok")).select(*names, F.lit(True).alias("is_base"), "start", "end")
    if model is not None:
        least = F.element_at(F.create_map(*[F.lit(x) for pair in _thresholds(_scored(model, labelled)).items() for x in pair]),
                             F.col("kind"))
        loose = _scored(model, featured.where(~is_base)).where(F.col("score") >= least) \
            .select(*names, F.lit(False).alias("is_base"), "start", "end")
        keep = keep.unionByName(loose)
    before = Window.partitionBy("rid").orderBy("start", F.col("is_base").desc(), F.col("end").desc(), "kind") \
        .rowsBetween(Window.unboundedPreceding, -1)
    # an added span inside earlier ones tells nothing new
    keep = keep.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0))) \
        .where(F.col("is_base") | (F.col("reach") < F.col("end")))
    none = found.select("rid", "doc_id").distinct().select(
        "rid", "doc_id", F.lit(None).cast("string").alias("kind"), F.lit(False).alias("is_base"),
        *[F.lit(None).cast("long").alias(c) for c in ("start", "end", "reach")])
    return keep.unionByName(none)


def _joined(items: Column) -> Column:
    """Spans as kind:start:end in the order of kinds, then starts."""
    return F.array_join(F.transform(F.array_sort(items), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in whole texts, one row per document row.

    Columns: doc_id, n_email, n_ip, n_card, n_phone (base spans per kind),
    base_sha256 (of the base spans as kind:start:end) and spans (all of them);
    places are code points, ends exclusive, spans may overlap.

    A null or empty text has none; null ids and repeated rows are judged row by
    row; an empty table gives no rows; without base candidates of both outcomes
    nothing is learned and only base spans remain; extra columns are ignored.
    """
    rows = prepared(docs).select(F.monotonically_increasing_id().alias("rid"), docs[id_col].cast("long").alias("doc_id"),
                                 docs[text_col].alias("text"))
    found = spans(candidates(rows))
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(PATTERNS) for x in (k, i)]), F.col("kind"))
    one = F.when(F.col("kind").isNotNull(), F.struct(rank.alias("rank"), "start", "end", "kind"))
    return found.groupBy("rid", "doc_id").agg(
        *[F.count(F.when(F.col("is_base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE],
        F.collect_list(F.when(F.col("is_base"), one)).alias("base"), F.collect_list(one).alias("every")) \
        .select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                _joined(F.col("every")).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every accepted span of its text replaced by its kind, as in ``[EMAIL]``.

    Overlapping spans become one.  Null texts stay null, empty ones empty, and all other
    columns and rows stay as they are (repeated texts are judged once).  An empty table
    gives no rows.
    """
    text = F.col("row").getField(text_col).cast("string")
    own = boxed(prepared(docs)).withColumn("rid", F.sha2(F.coalesce(text, F.lit("")), 256))
    found = candidates(own.select("rid", F.lit(None).cast("long").alias("doc_id"), text.alias("text"))) \
        .dropDuplicates(["rid", "kind", "nth"])
    cuts = spans(found).where("kind IS NOT NULL AND end > reach") \
        .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(
            F.greatest("start", "reach").alias("start"), "end", "reach", "kind"))).alias("cuts"))
    parts = F.transform("cuts", lambda c: F.concat(
        text.substr(c["reach"].cast("int") + 1, (c["start"] - c["reach"]).cast("int")),
        F.lit("["), F.upper(c["kind"]), F.lit("]")))
    last = F.element_at(F.col("cuts"), -1)["end"].cast("int")
    clean = F.concat(F.array_join(parts, ""), text.substr(last + 1, F.length(text)))
    joined = own.join(cuts, "rid", "left")
    return unboxed(joined, docs.columns, **{text_col: F.when(F.col("cuts").isNull(), F.col("row").getField(text_col)).otherwise(clean)})
