"""Request layer: JSON bodies -> validated, routed, capability-checked rows, and back to requests.

Bad requests are kept as rows with ``status`` / ``error`` / ``error_stage``; they are never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults and error prefixes of the service contract.
DEFAULT_MODEL = "default"
DEFAULT_RETURN_DENSE = True
DEFAULT_RETURN_SPARSE = False
VALID_PREFIX = "valid error: "
PARAM_PREFIX = "param check error: "
RUN_PREFIX = "run exception: "

_STRING_OR_LIST = "text: a string or a non-empty list of strings is required"
_ALLOWED_KEYS = {
    "embed": ["model", "text", "return_dense", "return_sparse"],
    "rerank": ["model", "query", "texts"],
    "rewrite": ["model", "message"],
}


def _kind(doc: Column, path: str) -> Column:
    """Type name of a field; NULL when the field is absent, 'VOID' when it is JSON null."""
    return F.schema_of_variant(F.variant_get(doc, path, "variant"))


def _list_of_strings(doc: Column, path: str, kind: Column) -> Column:
    """The list, or NULL unless every element is a string and there is at least one."""
    items = F.try_variant_get(doc, path, "array<string>")
    return F.when((kind == "ARRAY<STRING>") & ~F.exists(items, lambda x: x.isNull()), items)


def _optional(kind: Column, type_name: str, label: str) -> Column:
    return F.when(kind.isNotNull() & (kind != type_name), F.lit(label))


def _parse(df: DataFrame, body: str, kinds: dict[str, str]) -> DataFrame:
    """Parse the body once and note the type of every field of interest.

    The last value of a repeated key counts. Spark reads that choice from a session setting when it analyses the
    plan, so it is set here.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = df.withColumn("_doc", F.try_parse_json(F.col(body)))
    return parsed.withColumns({f"_{n}": _kind(F.col("_doc"), f"$.{n}") for n in kinds})


def _finish(
    df: DataFrame, body: str, request_type: str, problems: list[Column], outputs: dict[str, Column], strict: bool
) -> DataFrame:
    if strict:
        extra = F.array_except(
            F.json_object_keys(F.col(body)), F.array(*[F.lit(k) for k in _ALLOWED_KEYS[request_type]])
        )
        problems = [*problems, F.when(F.size(extra) > 0, F.concat(F.lit("unknown keys: "), F.array_join(extra, ", ")))]
    faults = F.concat_ws("; ", *problems)
    message = F.when(F.col("_doc").isNull(), F.lit("the body is not valid JSON")).when(faults != "", faults)
    checked = df.withColumn("_message", message)
    ok = F.col("_message").isNull()
    keep = [c for c in df.columns if not c.startswith("_") and c != body]
    row = F.struct(
        *[F.when(ok, value).alias(name) for name, value in outputs.items()],
        F.when(~ok, F.lit(400)).alias("status"),
        F.concat(F.lit(VALID_PREFIX), F.col("_message")).alias("error"),
        F.when(~ok, F.lit("validation")).alias("error_stage"),
    )
    # Behind a generator, so that filters on the status do not parse every body a second time.
    return checked.select(*keep, F.inline(F.array(row)))


def validate_embed(df: DataFrame, body: str = "body", strict: bool = True) -> DataFrame:
    """Adds ``model, texts, scalar_input, return_dense, return_sparse, status, error, error_stage``.

    Unknown keys are an error unless ``strict`` is off, as in the other two.
    """
    parsed = _parse(df, body, dict.fromkeys(["text", "model", "return_dense", "return_sparse"]))
    doc = F.col("_doc")
    scalar = F.col("_text") == "STRING"
    parsed = parsed.withColumn(
        "_texts",
        F.when(scalar, F.array(F.try_variant_get(doc, "$.text", "string"))).otherwise(
            _list_of_strings(doc, "$.text", F.col("_text"))
        ),
    )
    problems = [
        F.when(F.col("_texts").isNull(), F.lit(_STRING_OR_LIST)),
        _optional(F.col("_model"), "STRING", "model: a string is required"),
        _optional(F.col("_return_dense"), "BOOLEAN", "return_dense: a boolean is required"),
        _optional(F.col("_return_sparse"), "BOOLEAN", "return_sparse: a boolean is required"),
    ]
    outputs = {
        "model": F.coalesce(F.try_variant_get(doc, "$.model", "string"), F.lit(DEFAULT_MODEL)),
        "texts": F.col("_texts"),
        "scalar_input": scalar,
        "return_dense": F.coalesce(
            F.try_variant_get(doc, "$.return_dense", "boolean"), F.lit(DEFAULT_RETURN_DENSE)
        ),
        "return_sparse": F.coalesce(
            F.try_variant_get(doc, "$.return_sparse", "boolean"), F.lit(DEFAULT_RETURN_SPARSE)
        ),
    }
    return _finish(parsed, body, "embed", problems, outputs, strict)


def validate_rerank(df: DataFrame, body: str = "body", strict: bool = True) -> DataFrame:
    """Adds ``model, query, texts, status, error, error_stage``."""
    parsed = _parse(df, body, dict.fromkeys(["query", "texts", "model"]))
    doc = F.col("_doc")
    parsed = parsed.withColumn("_list", _list_of_strings(doc, "$.texts", F.col("_texts")))
    problems = [
        F.when(F.coalesce(F.col("_query"), F.lit("")) != "STRING", F.lit("query: a string is required")),
        F.when(F.col("_list").isNull(), F.lit("texts: a non-empty list of strings is required")),
        _optional(F.col("_model"), "STRING", "model: a string is required"),
    ]
    outputs = {
        "model": F.coalesce(F.try_variant_get(doc, "$.model", "string"), F.lit(DEFAULT_MODEL)),
        "query": F.try_variant_get(doc, "$.query", "string"),
        "texts": F.col("_list"),
    }
    return _finish(parsed, body, "rerank", problems, outputs, strict)


def validate_rewrite(df: DataFrame, body: str = "body", strict: bool = True) -> DataFrame:
    """Adds ``model, message, status, error, error_stage``. ``model`` is optional here as well."""
    parsed = _parse(df, body, dict.fromkeys(["message", "model"]))
    doc = F.col("_doc")
    turns = F.try_variant_get(doc, "$.message", "array<array<string>>")
    sound = (
        (F.col("_message") == "ARRAY<ARRAY<STRING>>")
        & F.forall(turns, lambda t: t.isNotNull() & (F.size(t) >= 1))
        & ~F.exists(turns, lambda t: F.exists(t, lambda x: x.isNull()))
    )
    parsed = parsed.withColumn("_turns", F.when(sound, turns))
    problems = [
        F.when(
            F.col("_turns").isNull(),
            F.lit("message: a non-empty list of non-empty lists of strings is required"),
        ),
        _optional(F.col("_model"), "STRING", "model: a string is required"),
    ]
    outputs = {
        "model": F.coalesce(F.try_variant_get(doc, "$.model", "string"), F.lit(DEFAULT_MODEL)),
        "message": F.col("_turns"),
    }
    return _finish(parsed, body, "rewrite", problems, outputs, strict)


def route_model(df: DataFrame, registry: DataFrame, model_type: str) -> DataFrame:
    """Attach the capabilities of the named model; an unknown name becomes a 400 row.

    ``registry`` holds one row per configured model, built on the driver, hence broadcast.
    """
    known = registry.where(F.col("model_type") == model_type).drop("model_type")
    joined = df.join(F.broadcast(known), "model", "left")
    lost = F.col("status").isNull() & F.col("model_cls").isNull()
    text = F.concat(F.lit("model name ["), F.col("model"), F.lit("] not found"))
    return joined.withColumns(
        {
            "status": F.when(lost, F.lit(400)).otherwise(F.col("status")),
            "error": F.when(lost, text).otherwise(F.col("error")),
            "error_stage": F.when(lost, F.lit("routing")).otherwise(F.col("error_stage")),
        }
    )


def check_capability(df: DataFrame) -> DataFrame:
    """400 where a requested output is one the model cannot give."""
    reason = F.when(
        F.col("return_dense") & ~F.col("supports_dense"), F.lit("the model has no dense output")
    ).when(F.col("return_sparse") & ~F.col("supports_sparse"), F.lit("the model has no sparse output"))
    bad = F.col("status").isNull() & reason.isNotNull()
    return df.withColumns(
        {
            "status": F.when(bad, F.lit(400)).otherwise(F.col("status")),
            "error": F.when(bad, F.concat(F.lit(PARAM_PREFIX), reason)).otherwise(F.col("error")),
            "error_stage": F.when(bad, F.lit("capability")).otherwise(F.col("error_stage")),
        }
    )


def explode_texts(df: DataFrame, texts: str = "texts", item: str = "text", spread: int | None = None) -> DataFrame:
    """One row per text with its position; a rejected request stays as one row without text.

    ``spread`` redistributes the exploded rows over that many partitions, so that a huge
    request does not keep a single task busy with the model.
    """
    accepted = F.when(F.col("status").isNull(), F.col(texts)) if "status" in df.columns else F.col(texts)
    rest = [c for c in df.columns if c != texts]
    rows = df.select(*rest, F.posexplode_outer(accepted).alias("pos", item))
    return rows.repartition(spread) if spread else rows


def expand_pairs(df: DataFrame, spread: int | None = None) -> DataFrame:
    """Rerank request -> one (query, text) row per text, order kept in ``pos``."""
    return explode_texts(df, "texts", "text", spread)


def project_outputs(df: DataFrame) -> DataFrame:
    """NULL for the outputs that were not asked for."""
    return df.withColumns(
        {
            "dense_embed": F.when(F.col("return_dense"), F.col("dense_embed")),
            "sparse_embed": F.when(F.col("return_sparse"), F.col("sparse_embed")),
        }
    )


def regroup_results(df: DataFrame, results: list[str], key: str = "request_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Row form -> one row per request, results in the original order.

    A group is as large as one request body was. Keep the row form for anything larger.
    A failed text fails its request.
    """
    item = F.struct("pos", *results)
    grouped = df.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), item))).alias("_items"),
        F.max("status").alias("status"),
        F.max("error").alias("error"),
        *[F.any_value(c).alias(c) for c in carry],
    )
    answer = F.transform(F.col("_items"), lambda r: F.struct(*[r[c].alias(c) for c in results]))
    served = F.coalesce(F.col("status"), F.lit(200)) == 200
    return grouped.withColumn("results", F.when(served, answer)).drop("_items")


def reject_corrupt_lines(rows: DataFrame, line: str = "corrupt_line", file: str = "source_file") -> DataFrame:
    """Validated rows in which lines that could not be read are 400 rows naming their file."""
    broken = F.col(line).isNotNull()
    reason = F.concat(F.lit(f"{VALID_PREFIX}the line is not a JSON request, in "), F.coalesce(F.col(file), F.lit("?")))
    return rows.withColumns({
        "status": F.when(broken, 400).otherwise(F.col("status")),
        "error": F.when(broken, reason).otherwise(F.col("error")),
        "error_stage": F.when(broken, "validation").otherwise(F.col("error_stage")),
    })


def complete_status(df: DataFrame) -> DataFrame:
    """200 for everything that was neither rejected nor failed."""
    return df.withColumn("status", F.coalesce(F.col("status"), F.lit(200)))
