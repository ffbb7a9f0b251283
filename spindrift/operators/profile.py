"""Profile of a vector table in one aggregate pass, and the findings that follow from it.

Findings are rules over the one profile row: each is a condition, a severity and a text. They come out as
a small DataFrame, worst first, in the order of the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vectors as V
from spindrift.operators import ranks
from spindrift.sources import scratch

BINS = 20
DUPLICATES_WARN, UNINDEXED_WARN = 0.01, 100_000
SEVERITIES = ("ok", "info", "warning", "error")


def per_row(df: DataFrame, vector: str = "vector", text: str | None = None, model: str | None = None) -> DataFrame:
    """is_null, dims, norm, vector_hash, has_text, text_hash, model of each row; vectors are not carried on."""
    v = F.col(vector)
    return df.select(
        v.isNull().alias("is_null"), V.dims(v).alias("dims"), V.norm(v).alias("norm"), F.md5(F.array_join(v.cast("array<string>"), ",")).alias("vector_hash"),
        (T.has_text(text) if text else F.lit(None).cast("boolean")).alias("has_text"),
        (F.when(T.has_text(text), F.md5(text)) if text else F.lit(None).cast("string")).alias("text_hash"),
        (F.when(v.isNotNull(), F.col(model).cast("string")) if model else F.lit(None).cast("string")).alias("model"),
    )


def _repeated(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row: how many rows repeat a value of the column. Each value's count is a partial aggregate."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias(name))


def profile(rows: DataFrame) -> DataFrame:
    """One row of statistics from per_row(), whose rows are stored as several passes read them."""
    nonzero = F.col("norm") >= V.ZERO
    rows = scratch.kept(rows, "profile")
    middle = ranks.at_ranks(rows, "norm", [], {"_low": ranks.lower_middle(), "_high": ranks.upper_middle()}).select(((F.col("_low") + F.col("_high")) / 2).alias("median_norm"))
    models = rows.where("model is not null").groupBy("model").count().agg(F.count("*").alias("models"))
    one = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_null").alias("null_vectors"), F.count_if(~F.col("is_null")).alias("vectors"), F.count_if("has_text").alias("texts_present"),
        F.count_distinct("dims").alias("sizes"), F.min("dims").alias("min_dims"), F.max("dims").alias("max_dims"),
        F.count_if(F.col("norm") < V.ZERO).alias("zero"), F.count_if(nonzero & (F.abs(F.col("norm") - 1) <= V.UNIT)).alias("unit"),
        F.min("norm").alias("min_norm"), F.max("norm").alias("max_norm"),
        F.min(F.when(nonzero, F.col("norm"))).alias("min_nonzero"), F.max(F.when(nonzero, F.col("norm"))).alias("max_nonzero"), F.count("model").alias("models_recorded"),
    )
    for more in (middle, models, _repeated(rows, "text_hash", "duplicate_texts"), _repeated(rows, "vector_hash", "duplicate_vectors")):
        one = one.crossJoin(F.broadcast(more))  # one row each
    return one.select(
        "rows", "null_vectors", "vectors", "texts_present", "duplicate_texts", "duplicate_vectors", "sizes", "min_dims", "max_dims", "zero", "unit",
        "min_norm", "median_norm", "max_norm", "min_nonzero", "max_nonzero", "models_recorded", "models",
    )


def counts(rows: DataFrame, column: str) -> DataFrame:
    """value, n: how often each value occurs, most common first by n."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, column: str = "norm", bins: int = BINS) -> DataFrame:
    """bin, start, end, n of equal-width bins, the last one closed; one bin where all values are as good as equal."""
    bounds = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo is not null")
    flat = F.col("hi") - F.col("lo") < 1e-9
    width = (F.col("hi") - F.col("lo")) / bins
    own = rows.select(F.col(column).alias("v")).where("v is not null").crossJoin(F.broadcast(bounds))  # one row
    binned = own.select(F.when(flat, 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.when(~flat, width)), F.lit(bins - 1))).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    all_bins = bounds.select("lo", "hi", F.explode(F.when(flat, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("bin"))
    return all_bins.join(binned, "bin", "left").select("bin", F.when(flat, F.col("lo")).otherwise(F.col("lo") + F.col("bin") * width).alias("start"), F.when(flat, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("end"), F.coalesce("n", F.lit(0)).alias("n"))


def model_source(columns: list[str], metadata: str | None = None) -> Column:
    """label<TAB>model of a row: a model column, else the first key of the metadata that has one; null without."""
    for c in MODEL_COLUMNS:
        if c in columns:
            return F.when(T.has_text(F.col(c)), F.concat(F.lit(f"{c}\t"), F.col(c)))
    if metadata is None:
        return F.lit(None).cast("string")
    paths = [k for k in MODEL_KEYS] + [f"{outer}.{k}" for outer in ("metadata", "meta") for k in MODEL_KEYS]
    return F.coalesce(*[F.when(F.nullif(json_path(metadata, p), F.lit("")).isNotNull(), F.concat(F.lit(f"{metadata}->>'{p}'\t"), json_path(metadata, p))) for p in paths])


#: Columns and metadata keys that may name the model of a row, and columns that hold text or change times, in order of priority.
MODEL_COLUMNS = ("model_tag", "embedding_model", "model", "model_name")
MODEL_KEYS = ("model_tag", "embedding_model", "model", "model_name")
TEXT_COLUMNS = ("content", "text", "page_content", "document", "chunk", "chunk_text", "body")
METADATA_COLUMNS = ("metadata", "cmetadata", "meta", "metadata_")
UPDATED_COLUMNS = ("updated_at", "modified_at", "last_modified", "last_modified_at", "changed_at", "updated", "modified")
GROUP_COLUMNS = ("document_id", "doc_id", "parent_id", "source_id", "file_id", "source", "url")


def json_path(column: str, path: str) -> Column:
    """A value inside JSON by its dotted path; null through what is no object."""
    return F.get_json_object(F.col(column), "$." + path)


class Findings:
    """Collects rules over one row: condition, id, severity, title, detail."""

    def __init__(self):
        self.rules: list[Column] = []

    def add(self, when: Column, name: str, severity: str | Column, title: str, detail: Column | str = "") -> None:
        severity = F.lit(severity) if isinstance(severity, str) else severity
        detail = F.lit(detail) if isinstance(detail, str) else detail
        self.rules.append(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(len(self.rules)).alias("ordinal"), F.lit(name).alias("id"), severity.alias("severity"), F.lit(title).alias("title"), detail.alias("detail"))))

    def of(self, row: DataFrame) -> DataFrame:
        """id, severity, rank, ordinal, title, detail: one row for each rule that holds."""
        found = row.select(F.explode(F.array_compact(F.array(*self.rules))).alias("f")).select("f.*")
        rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int") - 1
        return found.select("id", "severity", rank.alias("rank"), "ordinal", "title", "detail").orderBy(F.desc("rank"), "ordinal")


def of_total(part: str, whole: str, what: str) -> Column:
    """"3 of 100 rows (3%)" """
    return F.concat(F.col(part).cast("string"), F.lit(" of "), F.col(whole).cast("string"), F.lit(f" {what} ("), T.share(part, whole), F.lit(")"))


def doctor(
    p: DataFrame, store: str = "pgvector", vector_type: str = "vector", declared: int | None = None, estimated_rows: int | None = None, text_field: str | None = "text", model_field: str | None = None,
    updated_field: str | None = None, primary_key: bool = True, streamed: bool = False, indexes: list[tuple[str, str, str | None]] = (), most_dims: int | None = None, rows_hidden: bool = False, aliases: tuple[str, ...] | None = None,
) -> DataFrame:
    """All findings about a vector table from its profile() and what its schema says. indexes: (name, method, metric)."""
    f = Findings()
    some = F.col("rows") > 0
    f.add(~some, "sample.empty", "info", "No rows to inspect", "Only the schema was checked.")
    f.add(F.lit(rows_hidden), "access.row_security", "warning", "Access rules may hide rows", "The report covers the rows this reader can see.")
    if text_field is None:
        f.add(some, "text.missing", "error", "No source text", "Without the text beside the vectors they can't be embedded anew.")
    else:
        f.add(some & (F.col("texts_present") < F.col("rows")), "text.partial", "warning", "Some rows have no text", F.concat(of_total("_no_text", "rows", "rows"), F.lit(f" have no `{text_field}`.")))
        f.add(some & (F.col("texts_present") == F.col("rows")), "text.ok", "ok", "Source text available", f"Every row has `{text_field}`.")
    f.add(some & (F.col("null_vectors") > 0), "vectors.null", "warning", "Some rows have no vector", of_total("null_vectors", "rows", "rows"))
    f.add(F.col("sizes") > 1, "dims.mixed", "error", "Vectors of different sizes", F.concat(F.col("sizes").cast("string"), F.lit(" sizes, from "), F.col("min_dims").cast("string"), F.lit(" to "), F.col("max_dims").cast("string"), F.lit(".")))
    f.add(F.lit(declared is None), "dims.undeclared", "warning", "The schema fixes no vector size", f"`{vector_type}` is declared without a size.")
    f.add(F.lit(declared is not None) & (F.col("sizes") <= 1), "dims.ok", "ok", "One vector size", f"The schema fixes {declared} dimensions.")
    size = F.lit(declared) if declared is not None else F.col("max_dims")
    f.add(F.lit(most_dims is not None and not indexes) & (size > F.lit(most_dims or 0)), "dims.too_large_to_index", "warning", "Too many dimensions for an index", f"The limit is {most_dims}.")
    nonzero = F.col("vectors") - F.col("zero")
    f.add(some & (F.col("zero") > 0), "norms.zero", "error", "Zero vectors", of_total("zero", "vectors", "vectors"))
    f.add(some & (F.col("unit") > 0) & (F.col("unit") < nonzero), "norms.mixed", "warning", "Normalized and other vectors", of_total("unit", "vectors", "vectors have unit length"))
    f.add(some & (nonzero > 0) & (F.col("unit") == nonzero), "norms.ok", "ok", "Vectors are normalized", "Cosine, inner product and L2 rank alike.")
    f.add(some & (nonzero > 0) & (F.col("unit") == 0), "norms.unnormalized", "info", "Vectors aren't normalized", F.concat(F.lit("Lengths from "), F.round("min_nonzero", 3).cast("string"), F.lit(" to "), F.round("max_nonzero", 3).cast("string"), F.lit(".")))
    f.add(some & (F.col("unit") < nonzero) & F.lit(any(m == "inner_product" for _, _, m in indexes)), "norms.inner_product_unnormalized", "warning", "Inner-product index over vectors of different lengths", "Longer vectors rank higher whatever they mean.")
    f.add(some & (F.col("duplicate_texts") > DUPLICATES_WARN * F.col("texts_present")), "duplicates.text", "warning", "Duplicate texts", of_total("duplicate_texts", "texts_present", "texts"))
    f.add(some & (F.col("duplicate_vectors") > DUPLICATES_WARN * F.col("vectors")), "duplicates.vectors", "warning", "Duplicate vectors", of_total("duplicate_vectors", "vectors", "vectors"))
    f.add(some & (F.col("models") == 0), "models.untracked", "info", "No record of the model", "Store a model tag beside each vector.")
    f.add(some & (F.col("models") > 1), "models.mixed", "error", "Vectors of more than one model", F.concat(F.col("models").cast("string"), F.lit(f" models in `{model_field}`.")))
    f.add(some & (F.col("models") == 1), "models.ok", "ok", "One embedding model", f"Every recorded model in `{model_field}` is the same.")
    f.add(some & (F.col("models") > 0) & (F.col("models_recorded") < F.col("vectors")), "models.partial", "warning", "Some rows don't record their model", of_total("_no_model", "vectors", "vectors"))
    large = (estimated_rows or 0) > UNINDEXED_WARN
    f.add(F.lit(bool(indexes)), "index.ok", "ok", "Index present", ", ".join(f"{n} ({m}{', ' + d if d else ''})" for n, m, d in indexes))
    f.add(F.lit(not indexes), "index.missing", "warning" if large else "info", "No index", "Searches scan every row.")
    f.add(F.lit(not primary_key), "sync.no_primary_key", "error", "No primary key", "Without a stable id a migration can't resume.")
    feed = streamed and primary_key
    f.add(F.lit(feed), "sync.logical_replication", "ok", "Changes can be streamed")
    f.add(F.lit(bool(not feed and updated_field)), "sync.updated_at", "ok", "Changes can be tracked by time", f"`{updated_field}` says when a row changed.")
    trigger = not feed and not updated_field and store == "pgvector" and primary_key
    f.add(F.lit(trigger), "sync.trigger", "ok", "Changes are found by their text", "Rows whose text changed are embedded again.")
    f.add(F.lit(not feed and not updated_field and not trigger), "sync.none", "warning", "No way to track changes")
    f.add(F.lit(bool(aliases)), "alias.present", "ok", "Searches can switch in one step", ", ".join(aliases or ()))
    f.add(F.lit(aliases is not None and not aliases), "alias.none", "warning", "Switching needs a change in the application")
    return f.of(p.withColumn("_no_text", F.col("rows") - F.col("texts_present")).withColumn("_no_model", F.col("vectors") - F.col("models_recorded")))


def severity_counts(findings: DataFrame) -> DataFrame:
    """severity, n, and worst: whether it is the worst that occurs."""
    worst = findings.agg(F.max("rank").alias("top"))
    return findings.groupBy("severity", "rank").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(worst)).select("severity", "n", (F.col("rank") == F.col("top")).alias("worst"))  # one row
