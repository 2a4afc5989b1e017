"""Registry-shaped projections of a TPC-H-like table set.

Lets every operator run on ordinary order / line-item / event tables of any size.
All of them are narrow projections: no shuffle, whole tables, columns pruned at the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    """Lazy registry tables over the parquet files of one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    # ------------------------------------------------------------ dimensions
    @property
    def document_types(self) -> DataFrame:
        return self.table("region").select(
            (F.col("r_regionkey") + 1).cast("long").alias("id"),
            F.lower("r_name").alias("key"),
            F.col("r_name").alias("name"),
            F.when(F.col("r_regionkey") % 2 == 1, F.lower("r_name")).alias("short_name"),
            (F.col("r_regionkey") < 3).alias("is_system"),
        )

    @property
    def roles(self) -> DataFrame:
        """Role rows appearing among the users."""
        slug = F.col("role_slug")
        rank = F.when(slug == "staff", 1).when(slug == "admin", 2).otherwise(3).cast("long")
        return self.users.groupBy("role_slug").agg(F.first(rank).alias("id")).withColumnRenamed("role_slug", "slug")

    @property
    def users(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@example.org")).alias("email"),
            F.when(segment == "AUTOMOBILE", "admin").when(segment == "MACHINERY", "super_admin")
            .otherwise("staff").alias("role_slug"),
            F.when(segment == "AUTOMOBILE", 2).when(segment == "MACHINERY", 3).otherwise(1).cast("long").alias("role_id"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            _plus("timestamp'2024-01-01 00:00:00'", F.col("c_custkey"), "minute").alias("created_at"),
        )

    @property
    def document_templates(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            (k + 1).cast("long").alias("id"),
            F.col("n_name").alias("name"),
            (F.col("n_regionkey") + 1).cast("long").alias("document_type_id"),
            F.when(k % 2 == 0, "custom").otherwise("auto").alias("grouping_mode"),
            F.element_at(F.array(*[F.lit(s) for s in ("letter", "long_bond", "a4", "custom")]), (k % 4 + 1).cast("int"))
            .alias("paper_size"),
            F.when(k % 3 == 0, "landscape").otherwise("portrait").alias("orientation"),
            F.when(k % 8 == 3, (k * 10 + 100.5)).cast("double").alias("custom_width_mm"),
            F.when(k % 8 == 3, (k * 12 + 40.25)).cast("double").alias("custom_height_mm"),
            (k % 5 < 2).alias("is_active"),
        )

    @property
    def template_fields(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            k.alias("id"),
            (k % 25 + 1).alias("document_template_id"),
            F.col("p_name").alias("name"),
            F.when(k % 5 != 0, (k % 5) * 2).cast("int").alias("person_group"),
            F.when(k % 7 != 0, F.col("p_size") * 3).cast("int").alias("person_field_order"),
            (k % 10 / 10.0).cast("double").alias("x"),
            (k % 13 / 12.0).cast("double").alias("y"),
            F.lit(0.1).alias("width"),
            (F.col("p_size") / 500.0).alias("height"),
            k.cast("int").alias("sort_order"),
            (k % 4 != 0).alias("is_required"),
        )

    # ----------------------------------------------------------------- facts
    @property
    def records(self) -> DataFrame:
        k, submitted = F.col("o_orderkey"), F.col("o_orderstatus") != "O"
        created = F.col("o_orderdate").cast("timestamp")
        return self.table("orders").select(
            k.alias("id"),
            F.element_at(F.array(*[F.lit(s) for s in ("birth", "death", "marriage", "custom")]), (k % 4 + 1).cast("int"))
            .alias("doc_type"),
            F.when(k % 50 != 0, k % 4 + 1).alias("document_type_id"),
            (k % 25 + 1).alias("document_template_id"),
            F.when(k % 5 != 0, F.concat(F.lit("R-"), k.cast("string"))).alias("registry_number"),
            F.when(submitted, "submitted").otherwise("draft").alias("status"),
            F.concat(F.lit("Supplier#"), F.lpad((k % 100).cast("string"), 9, "0")).alias("ocr_model_key"),
            F.col("o_custkey").alias("created_by"),
            F.when(submitted, F.col("o_custkey")).alias("submitted_by"),
            F.when(submitted, _plus(created, k % 1440, "minute")).alias("submitted_at"),
            created.alias("created_at"),
        )

    @property
    def record_fields(self) -> DataFrame:
        part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
        grouped = F.col("l_orderkey") % 3 != 0
        return self.table("lineitem").select(
            line_id().alias("id"),
            F.col("l_orderkey").alias("record_id"),
            F.concat(F.lit("Field "), line.cast("string")).alias("name"),
            F.when(part % 11 != 0, F.concat(F.lit("part "), part.cast("string"))).alias("ocr_text"),
            F.when(supp % 19 != 0, F.concat(F.lit("part "), (part + F.when(supp % 7 == 0, 1).otherwise(0)).cast("string")))
            .otherwise("  ").alias("verified_value"),
            F.when(part % 13 != 0, 50 + F.col("l_quantity")).alias("ocr_confidence"),
            (F.col("l_returnflag") != "R").alias("is_required"),
            F.when(grouped & (supp % 4 != 0), supp % 4).cast("int").alias("person_group"),
            F.when(grouped & (supp % 5 != 0), part % 9).cast("int").alias("person_field_order"),
            F.when(part % 29 != 0, (line - 1) * 0.14).cast("double").alias("x"),
            (supp % 5 * 0.22).cast("double").alias("y"),
            (F.col("l_quantity") / 400.0 + 0.02).alias("width"),
            F.lit(0.05).alias("height"),
            line.alias("sort_order"),
        )

    @property
    def sheet_fields(self) -> DataFrame:
        """Boxes of register sheets: a sheet holds the orders of a range of keys, one row of boxes per order.

        Every fifth sheet bears stored groups and every eleventh holds a longer range.
        """
        key, line, supp = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
        long = F.floor(key / 640) % 11 == 0
        span = F.when(long, 640).otherwise(40)
        sheet = F.when(long, F.floor(key / 640) * 16).otherwise(F.floor(key / 40)).cast("long")
        row = key % span
        return self.table("lineitem").select(
            line_id().alias("id"),
            sheet.alias("record_id"),
            F.concat(F.lit("Field "), line.cast("string")).alias("name"),
            F.when(sheet % 5 == 0, (row % 4).cast("int")).alias("person_group"),
            F.when(sheet % 5 == 0, line).cast("int").alias("person_field_order"),
            F.when(F.col("l_partkey") % 29 != 0, 0.05 + (line - 1) * 0.12).cast("double").alias("x"),
            ((row + supp % 5 * 0.02) / span).cast("double").alias("y"),
            (F.col("l_quantity") / 2000.0 + 0.05).cast("double").alias("width"),
            (0.5 / span).cast("double").alias("height"),
            (row * 10 + line).cast("int").alias("sort_order"),
        )

    @property
    def change_requests(self) -> DataFrame:
        """Two requests per record."""
        k, j = F.col("o_orderkey"), F.col("j")
        state = (k + j) % 4
        created = F.col("o_orderdate").cast("timestamp")
        return self.table("orders").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).select(
            (k * 2 + j).alias("id"),
            k.alias("record_id"),
            F.element_at(F.array(*[F.lit(s) for s in ("pending", "approved", "rejected", "withdrawn")]), (state + 1).cast("int"))
            .alias("status"),
            F.concat(F.lit("Correct entry "), k.cast("string")).alias("reason"),
            (k % 6 == 0).alias("changes_registry_number"),
            F.when((k % 6 == 0) & (k % 5 != 0), F.concat(F.lit("R-"), k.cast("string"))).alias("current_registry_number"),
            F.when((k % 6 == 0) & (k % 12 != 0), F.concat(F.lit("N-"), (k + j).cast("string")))
            .alias("proposed_registry_number"),
            F.col("o_custkey").alias("requested_by"),
            F.when(state.isin(1, 2), F.col("o_custkey")).alias("reviewed_by"),
            F.when(state.isin(1, 2), _plus(created, j + 1, "day")).alias("reviewed_at"),
            _plus(created, j, "day").alias("created_at"),
        )

    @property
    def change_request_items(self) -> DataFrame:
        """Each line is touched by both requests of its record; some point at a removed field."""
        part, supp, j = F.col("l_partkey"), F.col("l_suppkey"), F.col("j")
        proposed = F.when((supp + j) % 9 != 0, F.concat(F.lit(" part "), (part + j).cast("string"))).otherwise(" ")
        return self.table("lineitem").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).select(
            F.concat_ws("-", line_id(), j.cast("string")).alias("id"),
            (F.col("l_orderkey") * 2 + j).alias("change_request_id"),
            F.concat(F.when(part % 17 == 0, "gone-").otherwise(""), line_id()).alias("record_field_id"),
            F.concat(F.lit("part "), part.cast("string")).alias("current_value"),
            proposed.alias("proposed_value"),
        )

    @property
    def audit_logs(self) -> DataFrame:
        e = F.col("event_id")
        known = e % 10 != 0
        return self.table("events").select(
            e.alias("id"),
            F.when(known, F.col("user_id")).alias("user_id"),
            F.when(known & (e % 3 != 0), F.concat(F.lit("Actor "), F.col("user_id").cast("string"))).alias("actor_name"),
            F.concat(F.lit("record."), "event_type").alias("action"),
            F.concat(F.initcap("event_type"), F.lit(" on entry #"), e.cast("string")).alias("description"),
            F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("type"), "event_type").alias("old_values"),
            F.map_concat(
                F.from_json("props", "map<string,string>"),
                F.create_map(F.lit("type"), "event_type", F.lit("password"), F.lit("s3cret")),
            ).alias("new_values"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )

    # ---------------------------------------------------------------- models
    @property
    def ocr_models(self) -> DataFrame:
        k, bal = F.col("s_suppkey"), F.abs("s_acctbal") / 10000.0
        scored = k % 5 != 0
        return self.table("supplier").select(
            k.alias("id"),
            F.col("s_name").alias("key"),
            F.concat(F.lit("Model "), k.cast("string")).alias("label"),
            (k == 7).alias("is_active"),
            F.when(scored, bal).alias("cer"),
            F.when(scored, bal * 1.5).alias("wer"),
            F.when(scored, 1 - bal).alias("exact_match"),
            F.when(scored, F.lit("form-scans")).alias("evaluation_dataset"),
            F.when(scored, F.when(k % 7 == 3, "val").otherwise("test")).alias("evaluation_split"),
            F.when(scored, k * 37).alias("evaluation_sample_count"),
            F.when(scored, F.sha2(F.col("s_name"), 256)).alias("evaluation_manifest_sha256"),
            F.when(scored, F.sha2(F.concat("s_name", F.lit("w")), 256)).alias("evaluation_weights_sha256"),
            F.when(scored, _plus("timestamp'2026-01-01 00:00:00'", k, "day")).alias("evaluated_at"),
            F.when(k % 9 == 0, F.lit("2026-03-01 00:00:00").cast("timestamp")).alias("disk_deleted_at"),
        )

    @property
    def remote_models(self) -> DataFrame:
        """The inventory: suppliers in credit, plus one new model per nation."""
        known = self.table("supplier").where("s_acctbal >= 0").select(
            F.col("s_name").alias("key"),
            F.concat(F.lit("Disk "), "s_name").alias("label"),
            (F.col("s_suppkey") % 3 == 0).alias("loaded"),
            F.when(F.col("s_suppkey") % 2 == 0, F.struct(
                (F.abs("s_acctbal") / 10000.0).alias("cer"), (F.abs("s_acctbal") / 9000.0).alias("wer"),
                F.lit(0.5).alias("exact_match"), F.lit("form-scans").alias("dataset"), F.lit("test").alias("split"),
                F.col("s_suppkey").alias("sample_count"), F.sha2(F.col("s_name"), 256).alias("manifest_sha256"),
                F.sha2(F.concat("s_name", F.lit("w")), 256).alias("weights_sha256"),
                F.lit("2026-02-01 00:00:00").cast("timestamp").alias("evaluated_at"),
            )).alias("evaluation"),
        )
        new = self.table("nation").select(
            F.col("n_name").alias("key"), F.lit(None).cast("string").alias("label"),
            F.lit(False).alias("loaded"), F.lit(None).cast(known.schema["evaluation"].dataType).alias("evaluation"),
        )
        return known.unionByName(new)

    # -------------------------------------------------------------- datasets
    @property
    def manifest(self) -> DataFrame:
        """One row per conversation turn; the label is its whole text."""
        c, t = F.col("conv_id"), F.col("turn")
        n = c * 101 + t
        return self.table("conversations").select(
            F.when(n % 41 == 0, "").otherwise(_turn_file()).alias("filename"),
            F.when(n % 13 == 0, "  ").when(n % 17 == 0, " unreadable ").otherwise(F.col("text")).alias("label"),
            F.when(n % 10 < 6, "train").when(n % 10 < 8, " Val ").when(n % 31 == 0, "").when(n % 29 == 0, "dev")
            .otherwise("test").alias("split"),
            F.lit("scan").alias("source"),
            n.alias("ord"),
        )

    @property
    def images(self) -> DataFrame:
        """Files on disk: most manifest rows have one; each page is an unlisted file."""
        c, t = F.col("conv_id"), F.col("turn")
        n = c * 101 + t
        listed = self.table("conversations").where(F.col("role") != "system").select(
            F.when(n % 10 < 6, "train").when(n % 10 < 8, "val").otherwise("test").alias("split"),
            _turn_file().alias("filename"),
            (F.length("text") * 10).cast("long").alias("length"),
        )
        extra = self.table("pages").select(
            F.lit("test").alias("split"),
            F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".PNG")).alias("filename"),
            F.length("html").cast("long").alias("length"),
        )
        return listed.unionByName(extra)

    @property
    def predictions(self) -> DataFrame:
        """Readings of the images: letters commonly confused, one word lost, or a failure."""
        c, t, text = F.col("conv_id"), F.col("turn"), F.col("text")
        n = c * 101 + t
        return self.table("conversations").select(
            _turn_file().alias("filename"),
            F.when(n % 3 == 0, F.replace(F.replace(text, F.lit("en"), F.lit("m")), F.lit("e"), F.lit("c")))
            .when(n % 3 == 1, F.regexp_replace(text, " [a-z]+ ", " ")).otherwise(text).alias("text"),
            (n % 1000 / 10.0).cast("double").alias("confidence"),
            F.when(n % 23 == 0, F.lit("cannot open file")).alias("error"),
        )

    @property
    def token_scores(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            F.col("user_id").alias("seq_id"), e.alias("pos"), F.col("event_type").alias("token"),
            F.when(e % 37 == 0, F.lit(float("-inf"))).otherwise(-F.col("value") / 100).alias("log_prob"),
        )

    @property
    def sign_in_attempts(self) -> DataFrame:
        return self.table("events").select(
            F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("@Example.org")).alias("email"),
            F.lit("10.0.0.1").alias("ip"),
            F.col("ts").cast("timestamp").alias("ts"),
            (F.col("event_type") == "purchase").alias("succeeded"),
            F.col("event_id").alias("id"),
        )

    @property
    def training_epochs(self) -> DataFrame:
        """Unnumbered epochs of each run, in time order."""
        return self.table("events").select(
            F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"),
            F.when(F.col("user_id") % 4 != 0, F.round(F.col("value"), 2)).alias("val_loss"),
            F.round(F.col("value") + 1, 2).alias("train_loss"),
            (F.col("event_id") % 100 + 1).cast("double").alias("seconds"),
        )


def _plus(base: Column | str, amount: Column, unit: str) -> Column:
    start = F.expr(base) if isinstance(base, str) else base
    amount = amount.cast("int")
    step = F.make_dt_interval(mins=amount) if unit == "minute" else F.make_dt_interval(days=amount)
    return start + step


def line_id() -> Column:
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return F.concat_ws("-", *[F.col(c).cast("long").cast("string") for c in keys])


def _turn_file() -> Column:
    return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".png"))
