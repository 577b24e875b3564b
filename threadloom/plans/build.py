"""The full build of an archive: stages 0-9, each from tables to a stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config
from ..functions.embed import embed_missing, get_embedder
from ..operators import audit, chunking, density, hydrate, mutate, topics
from ..sources import dumps, index


class EmptyInput(RuntimeError):
    """A stage has nothing to work on; the stage before it has to run first."""


class Archive:
    """The stored tables of one profile under ``base/profile``."""

    SCHEMAS = {
        "messages": schemas.MESSAGES, "chunks": schemas.CHUNKS, "topics_l1": schemas.TOPICS_L1, "topics_l2": schemas.TOPICS_L2,
        "index_chunks": schemas.INDEX, "index_l1": schemas.INDEX, "index_l2": schemas.INDEX,
    }

    def __init__(self, spark: SparkSession, base: str, profile: str = "default"):
        self.spark, self.root = spark, f"{base.rstrip('/')}/{profile}"

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v={version}"

    def _version(self, name: str) -> int:
        """The newest finished snapshot, or -1.  Snapshots are written whole, then read."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            return -1
        found = [s.getPath() for s in fs.listStatus(path)]
        done = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max((int(p.getName().split("=")[1]) for p in done), default=-1)

    def read(self, name: str) -> DataFrame:
        at = self._version(name)
        if at < 0:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.parquet(self._path(name, at))

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._path(name, self._version(name) + 1))

    def append(self, name: str, rows: list[dict]) -> None:
        """Add single rows to a table; missing fields are null."""
        schema = self.SCHEMAS[name]
        new = self.spark.createDataFrame([tuple(r.get(f) for f in schema.fieldNames()) for r in rows], schema)
        self.write(name, self.read(name).unionByName(new, allowMissingColumns=True))

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in self.SCHEMAS}

    def require_non_empty(self, name: str, why: str) -> DataFrame:
        df = self.read(name)
        if df.isEmpty():
            raise EmptyInput(f"no {name}: {why}")
        return df

    # --- stages --------------------------------------------------------------------

    def messages(self, incoming: DataFrame) -> None:
        """Stage 0: insert messages that are not stored yet."""
        stored = self.read("messages")
        fresh = hydrate.insert_new(stored, incoming)
        self.write("messages", stored.unionByName(fresh).repartitionByRange("chat_id", "ts").sortWithinPartitions("chat_id", "ts"))

    def chunks(self, cfg: Config = Config()) -> None:
        """Stage 1: chunks with ids that follow from their messages, so a rerun replaces them; a chunk
        whose id and text are as before keeps its vector."""
        m = self.require_non_empty("messages", "run stage 0 first")
        same = ["chunk_id", "_text"]
        known = self.read("chunks").filter(F.col("embedding").isNotNull())
        known = known.select("chunk_id", F.md5("text").alias("_text"), "embedding", "embedding_dim")
        fresh = mutate.evolve(chunking.chunk_messages(m, cfg), schemas.CHUNKS).drop("embedding", "embedding_dim").withColumn("_text", F.md5("text"))
        self.write("chunks", fresh.join(known, same, "left").select(*schemas.CHUNKS.fieldNames()))

    def vectors(self, cfg: Config = Config(), embedder: str = "hashing", **options) -> None:
        """Stage 2: embed what has no vector of the embedder's dimension."""
        c = self.require_non_empty("chunks", "run stage 1 first")
        run, dim = get_embedder(embedder, **({"dim": cfg.embed_dim} | options))
        self.write("chunks", embed_missing(c, run, dim).select(*c.columns))

    def chunk_index(self) -> None:
        """Stage 3."""
        c = self.require_non_empty("chunks", "run stage 1 first").filter(F.col("embedding").isNotNull())
        if c.isEmpty():
            raise EmptyInput("no vectors: run stage 2 first")
        self.write("index_chunks", index.build_chunk_index(c))

    def topics_l1(self, cfg: Config = Config()) -> None:
        """Stage 4: cluster chunk vectors, roll topics up, assign chunks."""
        c = self.require_non_empty("chunks", "run stage 1 first")
        labels = density.cluster(
            c, min_cluster_size=cfg.min_cluster_size, min_samples=cfg.min_samples, metric=cfg.metric, method=cfg.selection, epsilon=cfg.selection_epsilon
        )
        assigned = topics.assign_l1(c, labels).select(*c.columns)
        self.write("chunks", assigned)
        rolled = topics.rollup_l1(self.read("chunks"), cfg.metric)
        self.write("topics_l1", rolled.select(*schemas.TOPICS_L1.fieldNames()))

    def topic_index(self, level: str) -> None:
        """Stages 5 and 7."""
        t = self.require_non_empty(f"topics_{level}", "run the topic stages first")
        self.write(f"index_{level}", index.build_topic_index(t, level))

    def topics_l2(self, cfg: Config = Config()) -> None:
        """Stage 6: cluster topic centroids; too few topics leave everything as it is."""
        t = self.require_non_empty("topics_l1", "run stage 4 first")
        if t.limit(cfg.min_cluster_size).count() < cfg.min_cluster_size:
            return
        labels = density.cluster(
            t, "topic_id", "center_vec", min_cluster_size=cfg.min_cluster_size, min_samples=cfg.min_samples, metric=cfg.metric,
            method=cfg.selection, epsilon=cfg.selection_epsilon,
        )
        self.write("topics_l1", topics.assign_l2(t, labels).select(*t.columns))
        parents = self.read("topics_l1")
        self.write("topics_l2", topics.rollup_l2(parents, cfg.metric).select(*schemas.TOPICS_L2.fieldNames()))
        c = self.read("chunks")
        self.write("chunks", topics.propagate_l2(c, parents).select(*c.columns))

    def naming_requests(self, level: str, mode: str = "only_unnamed") -> DataFrame:
        """``topic_id, material`` for every topic that needs a title."""
        t = topics.unnamed(self.read(f"topics_{level}"), level, mode)
        c = self.read("chunks")
        if level == "l1":
            wanted = c.join(t.select(F.col("topic_id").alias("topic_l1_id")), "topic_l1_id", "left_semi")
            return topics.naming_material(topics.sample_chunks(wanted), "topic_id", "nth")
        return topics.naming_material(topics.representatives(t, self.read("topics_l1"), c), "l2_id", "place")

    def names(self, level: str, generate: Callable[[DataFrame], DataFrame], mode: str = "only_unnamed") -> None:
        """Stages 8 and 9: ``generate`` turns requests into ``topic_id, response`` rows."""
        t = self.read(f"topics_{level}")
        responses = generate(self.naming_requests(level, mode))
        self.write(f"topics_{level}", topics.apply_titles(t, responses).select(*t.columns))

    def reset(self, stage: int | None = None) -> None:
        """Back to before ``stage``; without one, all stages in reverse order."""
        before = self.tables()
        after = mutate.reset_all(before) if stage is None else mutate.reset_stage(before, stage)
        for name, df in after.items():
            if df is not before[name]:
                self.write(name, df)

    def report(self, token_min: int = 50) -> DataFrame:
        t = self.tables()
        return audit.ingest_report(t["messages"], t["chunks"], t["index_chunks"], t["topics_l1"], t["topics_l2"], token_min)


def build(spark: SparkSession, source: str | DataFrame, base: str, cfg: Config = Config(), profile: str = "default", generate=None) -> Archive:
    """All stages, from a dump path or a frame of messages to a searchable archive."""
    archive = Archive(spark, base, profile)
    incoming = dumps.to_messages(dumps.read_dump(spark, source)) if isinstance(source, str) else source
    archive.messages(incoming)
    archive.chunks(cfg)
    archive.vectors(cfg)
    archive.topics_l1(cfg)
    if not archive.read("topics_l1").isEmpty():
        archive.topic_index("l1")
        archive.topics_l2(cfg)
        if not archive.read("topics_l2").isEmpty():
            archive.topic_index("l2")
        if generate is not None:
            archive.names("l1", generate)
            archive.names("l2", generate)
    # the chunk index carries topic ids, so it is written last as well
    archive.chunk_index()
    return archive
