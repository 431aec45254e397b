"""Provenance: validation results of signed manifests flattened to rows, and the summary of a file's manifest store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismspark.session import work_folder

# Keys that give the statuses below them a kind.
KINDS = {
    "success": "success", "successes": "success",
    "failure": "failure", "failures": "failure", "error": "failure", "errors": "failure",
    "informational": "informational", "info": "informational", "warning": "informational", "warnings": "informational",
}


#: Steps into a tree that one plan takes; deeper trees take the plan again.
STEPS = 6
#: Columns of a status beside its scope and kind, with their types.
FIELDS = {"code": "string", "success": "boolean", "explanation": "string", "url": "string"}


def kind_of(lowered: Column, inherited: Column) -> Column:
    found = inherited
    for kind in sorted(set(KINDS.values())):
        found = F.when(lowered.isin(*(k for k, v in KINDS.items() if v == kind)), kind).otherwise(found)
    return found


#: Strings that start like a list, an object or a boolean (or by an escape, which may hide one) get a mark before they are parsed to
#: texts, so that the first character of a text tells its type. Only the quote that opens a string may precede these characters.
MARK, MARKED = "~", r'"(?=[{\[tf~\\])(?<!\\")'


def unmarked(text: Column) -> Column:
    return F.when(text.startswith(MARK), F.substring(text, 2, 1 << 30)).otherwise(text)


def is_tree(text: Column) -> Column:
    return text.startswith("{") | text.startswith("[")


def python_text(text: Column) -> Column:
    """A value as text: strings as they are, true, false and null as words with a capital, all else in JSON."""
    whole = F.when(is_tree(text), F.regexp_replace(text, rf'"{MARK}(?<!\\"{MARK})', '"')).otherwise(unmarked(text))
    return F.when(text.isNull(), "None").when(text.isin("true", "false"), F.initcap(text)).otherwise(whole)


def may_hold_status(text: Column) -> Column:
    """Whether an object or list has to be walked: a name without the letters of code can only be one if it is escaped."""
    return is_tree(text) & (text.contains("code") | text.contains("\\"))


def step(rows: DataFrame) -> DataFrame:
    """Each row with a node by rows for what takes its place, in their order: an object with a code keeps its members as the
    status that it is; other objects and lists give a row for each object or list in them."""
    read = lambda start, schema: F.when(F.col("node").startswith(start), F.from_json("node", schema, {"allowSingleQuotes": "false"}))
    rows = rows.withColumns({"members": read("{", "map<string,string>"), "items": read("[", "array<string>")})
    names = F.map_keys("members")
    own = F.coalesce(F.array_contains(names, "code") | F.array_contains(names, MARK + "code"), F.lit(False))
    rows = rows.withColumn("state", F.when(F.col("node").isNull(), "done").when(own, "status").when(F.col("items").isNotNull(), "list").otherwise("object"))
    whole, listed = F.col("state").isin("done", "status"), F.col("state") == "list"
    inner = F.when(whole, F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))))
    inner = inner.when(listed, F.arrays_zip(F.col("items").alias("key"), F.col("items").alias("value"))).otherwise(F.map_entries("members"))
    rows = rows.withColumn("inner", F.explode(inner)).filter(whole | may_hold_status(F.col("inner.value")))
    rows = rows.withColumn("name", F.when(F.col("state") == "object", unmarked(F.col("inner.key")))).withColumn("lowered", F.lower("name"))
    below = F.when(F.col("name").isNull(), F.col("scope")).when(F.col("scope") == "root", F.col("name")).otherwise(F.concat("scope", F.lit("."), "name"))
    kind = F.when(F.col("name").isNull(), F.col("kind")).otherwise(kind_of(F.col("lowered"), F.col("kind")))
    status = F.when(F.col("state") == "status", F.col("members")).otherwise(F.col("status"))
    return rows.withColumns({"node": F.col("inner.value"), "scope": below, "kind": kind, "status": status}).drop("members", "items", "state", "inner", "name", "lowered")


def told(rows: DataFrame) -> DataFrame:
    """Rows whose status is told by its members, of which the last of a name counts."""
    rows = rows.withColumns({"names": F.reverse(F.map_keys("status")), "texts": F.reverse(F.map_values("status"))})
    place = lambda name: F.nullif(F.array_position("names", name), F.lit(0))
    rows = rows.withColumns({f"own_{n}": F.get("texts", (F.least(place(n), place(MARK + n)) - 1).cast("int")) for n in FIELDS})
    text = {n: F.when(F.col(f"own_{n}").isNotNull(), python_text(F.col(f"own_{n}"))) for n in ("explanation", "url")}
    rows = rows.withColumn("flag", F.when(F.col("own_success").isin("true", "false"), F.col("own_success") == "true"))
    kind = F.coalesce("kind", F.when(F.col("flag"), "success").when(~F.col("flag"), "failure"), F.lit("status"))
    own = {"kind": kind, "code": python_text(F.col("own_code")), "success": F.col("flag"), **text}
    return rows.withColumns({n: F.when(F.col("status").isNotNull(), v).otherwise(F.col(n)) for n, v in own.items()})


def validation_rows(documents: DataFrame, column: str, key: str) -> DataFrame:
    """key, place, scope, kind, code, success, explanation, url: the flattened validation results of JSON texts.

    Every object with a code is a status; its scope is the names above it, its kind that of the nearest name above that has
    one, or else told by its own success flag. A tree is walked level by level, each node being replaced by rows for its own
    nodes in their order; rows are numbered as they come and then within their document.
    Rows with deeper trees than one plan walks are written and walked on. Null and unreadable texts, and those nested over
    1,000 deep, give no row.
    """
    spark = documents.sparkSession
    text = F.regexp_replace(F.ltrim(F.col(column), F.lit(" \t\n\x0b\f\r")), MARKED, f'"{MARK}')
    none = [F.lit(None).cast(t).alias(n) for n, t in (("kind", "string"), *FIELDS.items())]
    found = documents.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("document"), F.lit(0).alias("place"), F.coalesce(text, F.lit("")).alias("node"), F.lit("root").alias("scope"), *none)
    columns = ["_key", "place", "scope", "kind", *FIELDS]
    while True:
        found = found.withColumn("status", F.lit(None).cast("map<string,string>"))
        for _ in range(STEPS):
            found = step(found)
        order = Window.partitionBy("_key", "document").orderBy("place", "came")
        found = told(found).withColumn("came", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(order) - 1)
        folder = work_folder(spark, "statuses")
        found = found.select(*columns, "document", "node", F.col("node").isNotNull().alias("open"))
        found.write.parquet(folder)
        found = spark.read.schema(found.schema).parquet(folder)
        if found.filter("open").isEmpty():
            return found.select(*columns).withColumnRenamed("_key", key)


#: Entries that a summary lists at most: successes and failures, and all statuses. Counts are of all.
LISTED, LISTED_STATUSES, LISTED_IN_REASON = 50, 100, 8


def stores(documents: DataFrame, column: str, key: str) -> DataFrame:
    """key, active, state, producer, labels of manifest stores in JSON: the active manifest is looked up among the store's by
    its label; its own state counts before the store's. Null and unreadable texts have no active manifest."""
    text = F.col(column)
    manifests = F.from_json(F.get_json_object(text, "$.manifests"), "map<string,string>")
    active = F.get_json_object(text, "$.active_manifest")
    found = documents.select(key, active.alias("active"), F.try_element_at(manifests, active).alias("own"), F.get_json_object(text, "$.validation_state").alias("whole"))
    state = F.coalesce(F.get_json_object("own", "$.validation_state"), "whole")
    state = F.nullif(F.trim(F.regexp_replace(F.lower(state), "^validationstate[.]", "")), F.lit(""))
    labels = F.transform(F.from_json(F.get_json_object("own", "$.assertions"), "array<struct<label:string>>"), lambda x: x["label"])
    return found.select(key, "active", state.alias("state"), F.get_json_object("own", "$.claim_generator").alias("producer"), F.array_compact(F.coalesce(labels, F.array().cast("array<string>"))).alias("labels"))


def summary(stores: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Integrity and trust per store (key, active, state) from its validation rows. A valid or trusted state, or a validated
    claim signature, without failures and with an active manifest gives integrity; the state invalid forbids it. Trust is of
    the signer and comes from the state alone."""
    ok = (F.col("kind") == "success") | F.coalesce("success", F.lit(False))
    bad = (F.col("kind") == "failure") | ~F.coalesce("success", F.lit(True))

    def listed(rule: F.Column, most: int) -> F.Column:
        """Codes in document order; a store's statuses are part of one document."""
        return F.transform(F.slice(F.array_sort(F.collect_list(F.when(rule, F.struct("place", "code")))), 1, most), lambda x: x["code"])

    counted = rows.groupBy(key).agg(
        F.count_if(ok).alias("successes"), F.count_if(bad).alias("failures"), F.count_if(F.col("kind") == "informational").alias("informational"),
        F.coalesce(F.bool_or((F.col("code") == "claimSignature.validated") & ok), F.lit(False)).alias("signature_validated"),
        F.coalesce(F.bool_or((F.col("code") == "assertion.dataHash.match") & ok), F.lit(False)).alias("data_hash_validated"),
        listed(ok, LISTED).alias("success_codes"), listed(bad, LISTED).alias("failure_codes"), listed(F.lit(True), LISTED_STATUSES).alias("status_codes"),
    )
    none = F.array().cast("array<string>")
    joined = stores.join(counted, key, "left").fillna(0, ["successes", "failures", "informational"]).fillna(False, ["signature_validated", "data_hash_validated"])
    joined = joined.withColumns({n: F.coalesce(n, none) for n in ("success_codes", "failure_codes", "status_codes")})
    state, present = F.lower(F.coalesce("state", F.lit(""))), F.col("active").isNotNull()
    sound = (state.isin("valid", "trusted") | F.col("signature_validated")) & (F.col("failures") == 0) & present & (state != "invalid")
    # Names of trust and status.
    trust = F.when(state == "trusted", "trusted").when(state == "valid", "valid_but_not_trusted").when(state == "invalid", "invalid").when(present, "not_established").otherwise("not_applicable")
    status = F.when(sound, "validated").when((F.col("failures") > 0) | (state == "invalid"), "invalid").when(present, "manifest_present_unverified").otherwise("no_active_manifest")
    found = joined.select(key, "active", "state", "successes", "failures", "informational", "signature_validated", "data_hash_validated", "success_codes", "failure_codes", "status_codes", sound.alias("integrity_validated"), trust.alias("trust_status"), status.alias("status"))
    said = F.concat(F.lit("validation_state="), F.coalesce("state", F.lit("unknown")), F.lit("; trust_status="), F.col("trust_status"))
    failed = F.concat(said, F.lit("; failures="), F.array_join(F.slice("failure_codes", 1, LISTED_IN_REASON), ","))
    reason = F.when(F.col("failures") > 0, failed).when(F.col("status") == "validated", F.concat(said, F.lit("; no_validation_failures"))).when(F.col("active").isNotNull(), F.concat(said, F.lit("; manifest_present_but_not_validated")))
    return found.withColumn("reason", F.coalesce(reason, F.lit("no_active_manifest")))


def inspected(markers: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """key, tool, store, status, reason of each file of markers (key, marker): the first tool in order that gave a store
    (attempts: key, tool `library` or `command`, store, error), else the marker scan with the reason of the last failure."""
    each = attempts.groupBy(key).agg(
        F.max(F.when(F.col("tool") == "library", F.col("store"))).alias("library"), F.max(F.when(F.col("tool") == "command", F.col("store"))).alias("command"),
        F.max(F.when(F.col("tool") == "library", F.coalesce("error", F.lit("library_gave_nothing")))).alias("library_error"), F.max(F.when(F.col("tool") == "command", F.coalesce("error", F.lit("command_gave_nothing")))).alias("command_error"),
    )
    joined = markers.join(each, key, "left")
    tool = F.when(F.col("library").isNotNull(), "library").when(F.col("command").isNotNull(), "command").otherwise("marker_scan")
    status = F.when(tool != "marker_scan", "inspected").when(F.coalesce("marker", F.lit(False)), "marker_only").otherwise("unavailable")
    reason = F.when(tool == "marker_scan", F.coalesce("command_error", "library_error", F.lit("validator_not_available")))
    return joined.select(key, tool.alias("tool"), F.coalesce("library", "command").alias("store"), status.alias("status"), reason.alias("reason"))
