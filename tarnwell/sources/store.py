"""Collections as generations: a base table, segments of changes on top of it, and a log of versions.

A version is a small file that names the base, the segments and the schema. A batch is written as one segment
(whole documents and marks of deleted ids) in a folder of its own and becomes visible when the file of the next
version is created, which fails if another writer created it first; nothing that others wrote can be lost. Readers
keep the version they opened and merge on read: the last change of an id counts, and changed ids are anti-joined from
the base. Segments are folded into a new base when they become many.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.session import names_in, prepare, read_text, remove, size_of, write_new

NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")
SCHEMA = (
    "id bigint, text string, metadata string, chunk struct<parent: string, position: bigint>, vectors array<array<float>>, "
    "dense map<string, array<float>>, multivector map<string, array<array<float>>>, sparse map<string, array<struct<feature: bigint, weight: float>>>"
)
CHANGES = f"{SCHEMA}, _gone boolean, _no bigint"
#: Segments that are read on top of a base before they are folded into it, and bytes of a file of a base.
SEGMENTS = 16
FILE_BYTES = 256 << 20
MOST_TEXT, MOST_TOKENS, MOST_FIELDS, MOST_FEATURES = 1 << 20, 8192, 32, 65_536


@dataclass(frozen=True)
class IndexConfig:
    dimension: int
    centroids: int = 64
    residual_bits: int = 2
    probes: int = 4
    fde_repetitions: int = 20
    fde_ksim: int = 4
    fde_projected: int = 8
    analyzer: str = "plain"

    def __post_init__(self):
        numbers = (self.dimension, self.centroids, self.residual_bits, self.probes, self.fde_repetitions, self.fde_ksim, self.fde_projected)
        if min(numbers) < 1 or self.residual_bits > 8 or self.fde_ksim > 12:
            raise ValueError("config values must be positive, residual bits at most 8 and hash planes at most 12")


class ConfigMismatch(ValueError):
    pass


class InvalidDocument(ValueError):
    pass


class Conflict(RuntimeError):
    """Another writer published the next version first; nothing was changed."""


@dataclass
class Pointer:
    generation: int = 0
    base: str | None = None
    segments: list = field(default_factory=list)
    config: dict = field(default_factory=dict)
    fields: dict = field(default_factory=dict)
    batch_id: int | None = None


class Store:
    """One collection below ``path``."""

    def __init__(self, spark: SparkSession, path: str, config: IndexConfig | None = None):
        prepare(spark)
        self.spark, self.path = spark, path.rstrip("/")
        self.pointer = self._read()
        if self.pointer is None:
            if config is None:
                raise FileNotFoundError(f"no collection at {path}")
            self.pointer = self._publish(Pointer(0, None, [], asdict(config)))
        elif config is not None and asdict(config) != self.pointer.config:
            raise ConfigMismatch("the collection was created with another config")

    # The log of versions.

    def _version(self, generation: int) -> str:
        return f"{self.path}/log/{generation:020d}.json"

    def _read(self, generation: int | None = None) -> Pointer | None:
        if generation is None:
            found = [n for n in names_in(self.spark, f"{self.path}/log") if n.endswith(".json")]
            if not found:
                return None
            generation = int(found[-1].removesuffix(".json"))
        text = read_text(self.spark, self._version(generation))
        return text and Pointer(**json.loads(text))

    def _publish(self, pointer: Pointer) -> Pointer:
        if not write_new(self.spark, self._version(pointer.generation), json.dumps(asdict(pointer))):
            raise Conflict(f"generation {pointer.generation} exists already")
        self.pointer = pointer
        return pointer

    def refresh(self) -> int:
        """Move to the newest version."""
        self.pointer = self._read()
        return self.generation

    def _folder(self, kind: str) -> str:
        return f"{kind}-{self.generation + 1}-{uuid.uuid4().hex}"

    # Reading.

    @property
    def generation(self) -> int:
        return self.pointer.generation

    def documents(self, generation: int | None = None) -> DataFrame:
        pointer = self.pointer if generation in (None, self.generation) else self._read(generation)
        if pointer is None:
            raise FileNotFoundError(f"no generation {generation}")
        read, empty = self.spark.read, self.spark.createDataFrame([], SCHEMA)
        base = read.schema(SCHEMA).parquet(f"{self.path}/{pointer.base}") if pointer.base else empty
        if not pointer.segments:
            return base
        changes = read.schema(CHANGES).parquet(*[f"{self.path}/{s}" for s in pointer.segments])
        last = changes.withColumn("_rn", F.row_number().over(W.partitionBy("id").orderBy(F.desc("_no")))).where("_rn = 1")
        return base.join(last.select("id"), "id", "left_anti").select(*empty.columns).unionByName(last.where("NOT _gone").select(*empty.columns))

    def last_batch(self) -> int | None:
        return self.pointer.batch_id

    # Writing.

    def _validated(self, batch: DataFrame) -> tuple[DataFrame, dict]:
        """The batch with the collection's columns, and the fields it defines; any bad row refuses it whole."""
        have = set(batch.columns)
        types = {f.name: f.dataType for f in self.spark.createDataFrame([], SCHEMA).schema}
        df = batch.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
        bad_values = lambda a: F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        matrix_bad = lambda m: F.exists(m, lambda v: (F.size(v) != F.size(F.get(m, F.lit(0)))) | (F.size(v) == 0) | bad_values(v))
        dim = self.pointer.config["dimension"]
        yes = lambda c: F.coalesce(c, F.lit(False))
        wrong = (
            F.col("id").isNull()
            | yes(F.octet_length("text") > MOST_TEXT)
            | yes(F.size("vectors") > MOST_TOKENS)
            | yes(F.exists("vectors", lambda v: (F.size(v) != dim) | bad_values(v)))
            | yes(F.exists(F.map_values("dense"), lambda v: (F.size(v) == 0) | bad_values(v)))
            | yes(F.exists(F.map_values("multivector"), lambda m: (F.size(m) == 0) | (F.size(m) > MOST_TOKENS) | matrix_bad(m)))
            | yes(F.exists(F.map_values("sparse"), lambda s: (F.size(s) > MOST_FEATURES) | F.exists(s, lambda e: (e["feature"] < 0) | (e["weight"] < 0) | F.isnan(e["weight"]))))
            | yes(F.octet_length("chunk.parent") > 4096)
        )
        if not df.where(wrong).isEmpty():
            raise InvalidDocument("a document of the batch breaks a limit; nothing was written")
        fields = dict(self.pointer.fields)
        shape = {"dense": lambda v: F.size(v), "multivector": lambda v: F.size(F.get(v, F.lit(0))), "sparse": lambda v: F.lit(0)}
        for kind, size in shape.items():
            found = df.select(F.explode(kind).alias("name", "v")).select("name", size(F.col("v")).alias("n")).distinct().limit(1000).collect()
            for r in found:
                seen = [kind, r.n] if kind != "sparse" else [kind]
                if fields.setdefault(r.name, seen) != seen:
                    raise InvalidDocument(f"field {r.name!r} is {fields[r.name]}, not {seen}")
        if len(fields) > MOST_FIELDS:
            raise InvalidDocument("too many fields")
        return df, fields

    def apply(self, upserts: DataFrame | None, deletes: DataFrame | None, batch_id: int | None = None) -> int:
        """One new generation from a batch of whole documents and ids to delete, written as one segment.

        Of several documents of an id the last by the column ``seq`` counts; without that column a table has no
        order, and a batch with an id twice is refused. An empty batch and ids that do not exist change nothing.
        """
        pointer, parts = self.pointer, []
        if upserts is not None:
            if "seq" in upserts.columns:
                w = W.partitionBy("id").orderBy(F.desc("seq"))
                upserts = upserts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
            elif not upserts.groupBy("id").count().where("count > 1").isEmpty():
                raise InvalidDocument("an id occurs twice and no column seq says which document is the last")
            fresh, fields = self._validated(upserts)
            if deletes is not None:
                fresh = fresh.join(deletes.select(F.col("id").cast("bigint").alias("id")), "id", "left_anti")
            parts.append(fresh.withColumn("_gone", F.lit(False)))
        else:
            fields = pointer.fields
        if deletes is not None:
            gone = deletes.select(F.col("id").cast("bigint").alias("id")).distinct().join(self.documents().select("id"), "id", "left_semi")
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], SCHEMA).schema if f.name != "id"]
            parts.append(gone.select("id", *blank, F.lit(True).alias("_gone")))
        folder = self._folder("segment")
        rows = 0
        if parts:
            change = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            change.withColumn("_no", F.lit(pointer.generation + 1)).write.parquet(f"{self.path}/{folder}")
            rows = self.spark.read.schema(CHANGES).parquet(f"{self.path}/{folder}").count()
        if not rows:
            remove(self.spark, f"{self.path}/{folder}")
            if batch_id is None:
                return self.generation
        batch_id = pointer.batch_id if batch_id is None else batch_id
        segments = pointer.segments + [folder] * bool(rows)
        self._publish(Pointer(pointer.generation + 1, pointer.base, segments, pointer.config, fields, batch_id))
        if len(segments) > SEGMENTS:
            self.compact()
        return self.generation

    def upsert(self, batch: DataFrame) -> int:
        return self.apply(batch, None)

    def delete(self, id_: int) -> bool:
        before = self.generation
        return self.apply(None, self.spark.createDataFrame([(id_,)], "id bigint")) != before

    def bytes(self) -> int:
        """Bytes of the base and its segments."""
        p = self.pointer
        return sum(size_of(self.spark, f"{self.path}/{f}") for f in [*p.segments, *([p.base] if p.base else [])])

    def compact(self, files: int | None = None) -> dict:
        """Fold the segments into a new base of ``files`` files (by FILE_BYTES if not given) and report the bytes."""
        before, pointer, folder = self.bytes(), self.pointer, self._folder("base")
        files = files or max(1, -(-before // FILE_BYTES))
        self.documents().repartition(files).write.parquet(f"{self.path}/{folder}")
        try:
            self._publish(Pointer(pointer.generation + 1, folder, [], pointer.config, pointer.fields, pointer.batch_id))
        except Conflict:
            remove(self.spark, f"{self.path}/{folder}")
            raise
        after = self.bytes()
        return {"bytes_before": before, "bytes_after": after, "reclaimed": before - after}

    def vacuum(self, keep: int = 2) -> None:
        """Remove what only versions before the last ``keep`` read."""
        versions = [n for n in names_in(self.spark, f"{self.path}/log") if n.endswith(".json")]
        kept = [self._read(int(n.removesuffix(".json"))) for n in versions[-keep:]]
        used = {f for p in kept for f in [p.base, *p.segments]}
        newest = kept[-1].generation
        for name in names_in(self.spark, self.path):
            kind, _, rest = name.partition("-")
            # Folders of a generation that is still to be published are another writer's.
            if kind in ("base", "segment") and name not in used and int(rest.split("-")[0]) <= newest:
                remove(self.spark, f"{self.path}/{name}")
        for n in versions[:-keep]:
            remove(self.spark, f"{self.path}/log/{n}")

    def stats(self, eligible=None) -> dict:
        """Counts for planning, in one aggregate; with a filter also those of the eligible documents."""
        ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
        n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")), F.lit(0))
        tokens = F.size("vectors") > 0
        per = {name: F.col(kind[0])[name].isNotNull() for name, kind in self.pointer.fields.items()}
        row = self.documents().agg(
            F.count("*").alias("documents"), F.count("text").alias("text_documents"), n(tokens).alias("token_documents"),
            F.coalesce(F.sum(F.when(tokens, F.size("vectors"))), F.lit(0)).alias("token_vectors"), n(ok).alias("eligible"),
            *[n(c).alias(f"f_{i}") for i, c in enumerate(per.values())], *[n(c & ok).alias(f"e_{i}") for i, c in enumerate(per.values())],
        ).first().asDict()
        out = {k: row[k] for k in ("documents", "text_documents", "token_documents", "token_vectors", "eligible")}
        out["fields"] = {name: row[f"f_{i}"] for i, name in enumerate(per)}
        out["eligible_fields"] = {name: row[f"e_{i}"] for i, name in enumerate(per)}
        return out | {"generation": self.generation}


class Collections:
    """Named collections below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _checked(self, name: str) -> str:
        if not NAME.fullmatch(name):
            raise ValueError("a name has 1 to 64 letters, digits, _ or -")
        return f"{self.root}/{name}"

    def create(self, name: str, config: IndexConfig) -> Store:
        return Store(self.spark, self._checked(name), config)

    def get(self, name: str) -> Store:
        return Store(self.spark, self._checked(name))

    def names(self) -> list[str]:
        return names_in(self.spark, self.root)
