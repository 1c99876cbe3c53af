"""The chunk table: Parquet in folders that never change, and a manifest that says which are in force.

A change writes what is new: a folder of added rows, and a folder of the keys that it removes or replaces. Readers leave out rows whose key was removed by a later version
than theirs, so a change costs in proportion to itself; ``compact`` writes a tenant anew once many folders have come together. Index folders (``postings``) belong to data
folders and are written with them. The new manifest is renamed into place without overwriting, so of two writers one fails; readers keep the version that they began with.

Migrations are what a store can be brought to, in order and by name, some of them only if their feature is asked for; the manifest says which were applied, and
each takes effect in one commit.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import text as X
from ..functions.languages import bm25_group_of, fts_config_of
from . import postings

KEY = ("tenant_id", "source_type", "source_id")
FEATURES = ("rls", "cjk", "vectorchord", "textsearch")
TENANT = "app.current_tenant_id"


def schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", T.StringType(), False),
            T.StructField("tenant_id", T.StringType(), False),
            T.StructField("source_type", T.StringType(), False),
            T.StructField("source_id", T.StringType()),
            T.StructField("chunk_index", T.StringType()),
            T.StructField("content", T.StringType(), False),
            T.StructField("content_normalized", T.StringType()),
            T.StructField("language", T.StringType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("metadata", T.StringType()),
            T.StructField("created_at", T.TimestampType()),
        ]
    )


VERSION = "_version"
COMPACT_AFTER = 32  # folders of a tenant
log = logging.getLogger(__name__)


class Conflict(RuntimeError):
    """Somebody else changed the table meanwhile."""


@dataclass
class DocumentStore:
    spark: SparkSession
    path: str
    dimensions: int = 384
    features: frozenset[str] = field(default_factory=frozenset)
    compact_after: int = COMPACT_AFTER

    def __post_init__(self) -> None:
        unknown = set(self.features) - set(FEATURES)
        if unknown:
            raise ValueError(f"unknown features: {sorted(unknown)}")
        if self.dimensions <= 0:
            raise ValueError("dimensions must be positive")

    # the manifest

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        fs, p = self._fs(f"{self.path}/_manifests")
        return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=0) if fs.exists(p) else 0

    def manifest(self, version: int | None = None) -> dict:
        """{tenants: {tenant: {data: [folder], gone: [folder]}}, migrations: {name: time}, indexes: [kind]} of a version."""
        version = self.version() if version is None else version
        empty = {"tenants": {}, "migrations": {}, "indexes": []}
        if not version:
            return empty
        return empty | json.loads(self.spark.read.text(f"{self.path}/_manifests/{version}", wholetext=True).first()["value"])

    def _commit(self, version: int, manifest: dict) -> int:
        """The next version. Renamed into place by a call that doesn't overwrite."""
        fs, tmp = self._fs(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop
        final = jvm.fs.Path(f"{self.path}/_manifests/{version + 1}")
        none = self.spark.sparkContext._gateway.new_array(jvm.fs.Options.Rename, 0)
        try:
            jvm.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, final, none)
        except Exception as e:
            if fs.exists(tmp):
                fs.delete(tmp, False)
            if fs.exists(final):
                raise Conflict(f"version {version + 1} is there already") from e
            raise
        return version + 1

    # reading

    def _read(self, folders: list[str], kind: T.StructType) -> DataFrame:
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], kind)

    def _live(self, manifest: dict, tenant: str | None) -> DataFrame:
        """Rows in force, with the version that wrote them."""
        own = [v for t, v in manifest["tenants"].items() if tenant is None or t == tenant]
        rows = self._read([f for v in own for f in v["data"]], _stored())
        if gone := [f for v in own for f in v["gone"]]:
            later = self._read(gone, _keys()).groupBy(*KEY).agg(F.max(VERSION).alias("_gone")).select(*[F.col(c).alias(f"_{c}") for c in KEY], "_gone")
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
            rows = rows.join(later, [*same, F.col("_gone") > F.col(VERSION)], "left_anti")
        return rows if tenant is None else rows.where(F.col("tenant_id") == tenant)

    def _tenant(self, tenant: str | None, manifest: dict) -> tuple[str | None, bool]:
        """(tenant, whether it may read): without a tenant, row-level security shows that of the session, or nothing."""
        if tenant is None and ("rls" in self.features or any("rls" in m for m in manifest["migrations"])):
            tenant = self.spark.conf.get(TENANT, None)
            return tenant, tenant is not None
        return tenant, True

    def scan(self, tenant: str | None = None, version: int | None = None) -> DataFrame:
        """One tenant's rows; of all tenants if none is given and row-level security is off, and no row if it is on."""
        manifest = self.manifest(version)
        tenant, may = self._tenant(tenant, manifest)
        return self._live(manifest, tenant).select(*schema().names, *DERIVED) if may else self.spark.createDataFrame([], schema())

    def index(self, kind: str, tenant: str | None = None) -> DataFrame:
        """Postings of the kind, of rows in force. The store must have been migrated to it."""
        manifest = self.manifest()
        if kind not in manifest["indexes"]:
            raise ValueError(f"the store has no {kind} index")
        tenant, may = self._tenant(tenant, manifest)
        own = {t: v for t, v in manifest["tenants"].items() if may and (tenant is None or t == tenant)}
        rows = self._read([f"index/{kind}/{f}" for v in own.values() for f in v["data"]], postings.SCHEMAS[kind])
        if any(v["gone"] for v in own.values()):
            rows = rows.join(self._live(manifest, tenant).select("id", VERSION), ["id", VERSION], "left_semi")
        return rows if tenant is None else rows.where(F.col("tenant_id") == tenant)

    # writing

    def prepare(self, rows: DataFrame) -> DataFrame:
        """Rows with all columns: defaults filled in, the id from the key and the content where none is given."""
        for f in schema():
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        made = F.sha2(F.to_json(F.struct(*KEY, "chunk_index", "content")), 256)
        rows = rows.withColumn("chunk_index", F.coalesce("chunk_index", F.lit("0"))).withColumn("language", F.coalesce("language", F.lit("en")))
        rows = rows.withColumn("id", F.coalesce("id", made)).withColumn("content_normalized", F.coalesce("content_normalized", "content"))
        rows = rows.withColumn("metadata", F.coalesce("metadata", F.lit("{}"))).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
        bad = F.col("embedding").isNotNull() & (F.size("embedding") != self.dimensions)
        rows = rows.withColumn("embedding", F.when(bad, F.raise_error(F.lit(f"an embedding hasn't {self.dimensions} dimensions")).cast("array<float>")).otherwise(F.col("embedding")))
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema()])

    def _parts(self, name: str, tenants: list[str]) -> dict[str, str]:
        fs, _ = self._fs(self.path)
        parts = {t: f"{name}/_tenant={self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(t)}" for t in tenants}
        return {t: p for t, p in parts.items() if fs.exists(self._fs(f"{self.path}/{p}")[1])}

    def _write(self, rows: DataFrame, tenants: list[str], indexes: list[str]) -> dict[str, str]:
        """One job for all tenants: a folder with a part for each, and index folders like it."""
        name = f"data/{uuid.uuid4().hex}"
        derived(rows).withColumn("_tenant", F.col("tenant_id")).write.partitionBy("_tenant").parquet(f"{self.path}/{name}")
        parts = self._parts(name, tenants)
        for kind in indexes:
            self._index(kind, list(parts.values()))
        return parts

    def _index(self, kind: str, folders: list[str]) -> None:
        for f in folders:
            postings.build(kind, self._read([f], _stored())).write.mode("overwrite").parquet(f"{self.path}/index/{kind}/{f}")

    def _change(self, keys: DataFrame | None, rows: DataFrame | None) -> int:
        version = self.version()
        manifest = self.manifest(version)
        new = None if rows is None else self.prepare(rows).withColumn(VERSION, F.lit(version + 1).cast("long"))
        gone = None if keys is None else keys.select(*KEY).distinct().withColumn(VERSION, F.lit(version + 1).cast("long"))
        touched: dict[str, dict] = {}

        def own(t: str) -> dict:
            if t not in touched:
                touched[t] = {k: list(v) for k, v in manifest["tenants"].get(t, {"data": [], "gone": []}).items()}
            return touched[t]

        if new is not None:
            tenants = [r[0] for r in new.select("tenant_id").distinct().collect()]
            for t, part in (self._write(new, tenants, manifest["indexes"]) if tenants else {}).items():
                own(t)["data"].append(part)
        if gone is not None:
            tenants = [t for (t,) in gone.select("tenant_id").distinct().collect() if t in manifest["tenants"]]  # others have nothing to remove
            name = f"gone/{uuid.uuid4().hex}"
            if tenants:
                gone.where(F.col("tenant_id").isin(tenants)).withColumn("_tenant", F.col("tenant_id")).write.partitionBy("_tenant").parquet(f"{self.path}/{name}")
            for t, part in self._parts(name, tenants).items():
                own(t)["gone"].append(part)
        if not touched:
            return version
        self._commit(version, manifest | {"tenants": manifest["tenants"] | touched})
        for t, v in touched.items():
            if len(v["data"]) + len(v["gone"]) > self.compact_after:
                try:
                    self.compact(t)
                except Conflict:  # the change itself is made; somebody else may compact
                    log.info("tenant %s was changed while it was compacted", t)
        return version + 1

    def insert(self, rows: DataFrame) -> int:
        """Appends; the version then in force. Nothing happens without rows."""
        return self._change(None, rows)

    def replace_sources(self, keys: DataFrame, rows: DataFrame | None) -> int:
        """Removes all rows of the keys (tenant_id, source_type, source_id) and adds the new ones, in one step. Keys without new rows are only removed. Nothing else is
        read or written."""
        return self._change(keys, rows)

    def delete_source(self, tenant: str, source_type: str, source_id: str | None) -> int:
        return self.replace_sources(self.spark.createDataFrame([(tenant, source_type, source_id)], "tenant_id string, source_type string, source_id string"), None)

    def compact(self, tenant: str) -> int:
        """Writes the tenant's rows in force into one folder. Older versions can still be read."""
        version = self.version()
        manifest = self.manifest(version)
        if tenant not in manifest["tenants"]:
            return version
        parts = self._write(self._live(manifest, tenant).drop(*DERIVED), [tenant], manifest["indexes"])
        self._commit(version, manifest | {"tenants": manifest["tenants"] | {tenant: {"data": list(parts.values()), "gone": []}}})
        return version + 1

    # migrations

    def migrate(self, migrations: tuple[Migration, ...] | None = None) -> list[str]:
        """Applies the migrations that are pending, in the order of their names; those with a feature only if the store has it. One commit each: one that fails leaves
        nothing, and those before it stand. The names applied."""
        applied = []
        for m in sorted(MIGRATIONS if migrations is None else migrations, key=lambda m: m.name):
            if m.feature is not None and m.feature not in self.features:
                continue
            version = self.version()
            manifest = self.manifest(version)
            if m.name in manifest["migrations"]:
                continue
            changed = m.apply(self, manifest)
            self._commit(version, changed | {"migrations": manifest["migrations"] | {m.name: time.time()}})
            applied.append(m.name)
        return applied


@dataclass(frozen=True)
class Migration:
    name: str
    apply: Callable[[DocumentStore, dict], dict]  # the manifest as it is to be
    feature: str | None = None


def _indexed(kind: str) -> Callable[[DocumentStore, dict], dict]:
    def apply(store: DocumentStore, manifest: dict) -> dict:
        store._index(kind, [f for v in manifest["tenants"].values() for f in v["data"]])
        return manifest | {"indexes": sorted({*manifest["indexes"], kind})}

    return apply


MIGRATIONS = (
    Migration("001_documents", lambda store, manifest: manifest),
    Migration("002_trigram_postings", _indexed("trigram")),
    Migration("003_lexeme_postings", _indexed("lexeme")),
    Migration("004_rls", lambda store, manifest: manifest, "rls"),
    Migration("005_cjk_bigram_postings", _indexed("bigram"), "cjk"),
    Migration("006_vectorchord_codes", _indexed("code"), "vectorchord"),
    Migration("007_textsearch_term_postings", _indexed("term"), "textsearch"),
)
DERIVED = ("config", "fts_group", "n_terms")


def derived(rows: DataFrame) -> DataFrame:
    """Adds what the search legs would make of each row again and again: text configuration, index group and number of words."""
    text = F.coalesce("content_normalized", "content", F.lit(""))
    return rows.withColumn("config", fts_config_of(F.coalesce("language", F.lit("")))).withColumn("fts_group", bm25_group_of(F.coalesce("language", F.lit("")))).withColumn("n_terms", F.size(X.tokens(text)))


def _stored() -> T.StructType:
    return T.StructType([*schema(), T.StructField(VERSION, T.LongType()), T.StructField("config", T.StringType()), T.StructField("fts_group", T.StringType()), T.StructField("n_terms", T.IntegerType())])


def _keys() -> T.StructType:
    return T.StructType([*(T.StructField(c, T.StringType()) for c in KEY), T.StructField(VERSION, T.LongType())])


def read_jsonl(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Rows of a file of JSON lines. Blank lines are skipped; lines that are no JSON are left out, with a warning that says how many."""
    kind = T._parse_datatype_string(columns)
    bad = "_bad_line"
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = F.from_json("value", T.StructType([*kind, T.StructField(bad, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = lines.select(read.alias("r")).select("r.*")
    if broken := rows.where(F.col(bad).isNotNull()).count():
        log.warning("%d lines of %s are no JSON", broken, path)
    return rows.where(F.col(bad).isNull()).drop(bad)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines, null fields too."""
    rows.write.json(path, ignoreNullFields=False)


def write_results(spark: SparkSession, path: str, tables: dict[str, DataFrame], **facts) -> None:
    """One JSON file of an evaluation: facts as they are, and small tables (summaries, slices) as lists of rows."""
    bundle = facts | {name: [json.loads(x) for x in df.toJSON().collect()] for name, df in tables.items()}
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(json.dumps(bundle, ensure_ascii=False, indent=1, sort_keys=True).encode()))
    out.close()


def read_pages(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """(doc, page, text) of files, one row a page from 1 on, by a function that reads one file (of PDF or another format; none is built in). A file that it can't read
    has no rows."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"]):
                try:
                    rows += [(name, k, t) for k, t in enumerate(pages_of(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001 - whatever a broken file makes the reader raise
                    logging.getLogger(__name__).warning("%s can't be read: %s", name, e)
            yield pd.DataFrame(rows, columns=["doc", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc string, page int, text string")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(id, domain, provider, target_doc, target_snippet, variant, text) of a queries file; fails if it isn't one."""
    kind = "version int, queries array<struct<id:string,domain:string,provider:string,target_doc:string,target_snippet:string,variants:map<string,string>>>"
    file = spark.read.schema(kind).json(path, multiLine=True, mode="FAILFAST")
    checked = file.withColumn("queries", F.when(F.col("version").isNull() | F.col("queries").isNull(), F.raise_error(F.lit("no queries file")).cast(file.schema["queries"].dataType)).otherwise(F.col("queries")))
    q = checked.select(F.explode("queries").alias("q")).select("q.*")
    return q.select(*[c for c in q.columns if c != "variants"], F.explode("variants").alias("variant", "text"))

