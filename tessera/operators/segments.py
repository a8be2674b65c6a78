"""A full-text index that is kept up to date: immutable segments, tombstones and merging.

Rows belong to an owner (a file or a page). An update writes one segment with the postings of the owners that changed and
one small table that names them; older rows of these owners are dead from then on. Nothing else is read or written, and both
count from the moment a version names them. Segments of like size are merged, which drops dead rows, so a question reads a
number of segments that grows with the logarithm of the index. A segment is one folder or several: a merge takes over the
folders whose files are of full size and without dead rows as they are, as writing them again would give as many files.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.fulltext import POSTINGS_PER_TASK, phrase_matches, postings
from tessera.operators.search import K1, B
from tessera.sources.durable import Kept
from tessera.sources.versions import Versions

#: Segments of about one size that are merged to one; sizes are told apart by powers of this.
FAN = 4
#: Bytes of text that make a posting, about: how many tasks a segment is written by is known before its terms are.
BYTES_PER_POSTING = 6

_POSTINGS = "owner string, term string, field int, position int, id string, seq long"
_LENGTHS = "owner string, id string, length int, seq long"
_OWNERS = "owner string, hash string, seq long"


class SegmentedIndex:
    def __init__(self, spark: SparkSession, root: str, *, owner_col: str = "path", id_col: str = "chunk_id", text_cols: tuple[str, ...] = ("content", "title", "section_header")):
        self.spark, self.root = spark, root.rstrip("/")
        self.owner_col, self.id_col, self.text_cols = owner_col, id_col, list(text_cols)
        self.versions = Versions(spark, root)

    def entries(self) -> dict:
        return self.versions.read()[1] or {"seq": 0, "segments": [], "tombstones": []}

    # What is live

    @staticmethod
    def _parts(segment: dict) -> list[dict]:
        """The folders of a segment; one of its own name, if it lists none."""
        return segment.get("parts") or [segment]

    def _read(self, kind: str, ddl: str, segments: list[dict]) -> DataFrame:
        base = f"{self.root}/{kind}"
        paths = [self._to(kind, p["name"]) for s in segments for p in self._parts(s)]
        return self.spark.read.option("basePath", base).schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def _alive(self, rows: DataFrame, entries: dict) -> DataFrame:
        """rows without those of owners that a later update names."""
        paths = [f"{self.root}/tombstones/{t['name']}" for t in entries["tombstones"]]
        if not paths:
            return rows
        dead = self.spark.read.schema("owner string, until long").parquet(*paths).groupBy(F.col("owner").alias("_owner")).agg(F.max("until").alias("_until"))
        return rows.join(dead, (rows["owner"] == dead["_owner"]) & (rows["seq"] < dead["_until"]), "left_anti")

    def _live(self, kind: str, ddl: str, entries: dict, segments: list[dict] | None = None) -> DataFrame:
        return self._alive(self._read(kind, ddl, entries["segments"] if segments is None else segments), entries)

    def owners(self) -> DataFrame:
        """(owner, hash): what the index holds, by the hash of what it was made from."""
        return self._live("owners", _OWNERS, self.entries()).select("owner", "hash")

    def changes(self, files: DataFrame, hash_col: str = "hash") -> tuple[DataFrame, DataFrame]:
        """(owners to index, owners to remove) when files (owner column, hash) is what there is now."""
        held, now = self.owners(), files.select(F.col(self.owner_col).alias("owner"), F.col(hash_col).alias("hash"))
        stale = now.join(held, ["owner", "hash"], "left_anti").select(F.col("owner").alias(self.owner_col))
        gone = held.join(now, "owner", "left_anti").select(F.col("owner").alias(self.owner_col))
        return stale, gone

    # Upkeep

    def _to(self, kind: str, name: str) -> str:
        return f"{self.root}/{kind}/segment={name}"

    def _write_postings(self, name: str, rows: DataFrame) -> None:
        """Each file is sorted by term and holds whole chunks: no posting is shuffled, and a question reads the row groups and pages of its words in each file."""
        rows.sortWithinPartitions("term").write.parquet(self._to("postings", name))

    def _described(self, name: str, seq: int) -> dict:
        docs, total = self._read("lengths", _LENGTHS, [{"name": name}]).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return {"name": name, "docs": docs, "length": total, "seq": seq, "owners": self._read("owners", _OWNERS, [{"name": name}]).count()}

    def update(self, chunks: DataFrame, owners: DataFrame, removed: DataFrame | None = None) -> int:
        """Index chunks of owners (owner column, hash) anew and forget removed owners: one version, returned by its number.

        owners names every owner that is indexed now, also one without chunks; chunks of others are left out. An update of
        nothing makes no version.
        """
        version, entries = self.versions.read()
        entries = entries or {"seq": 0, "segments": [], "tombstones": []}
        seq, name = entries["seq"] + 1, uuid.uuid4().hex
        keep = Kept(self.spark)
        fresh = keep(owners.select(F.col(self.owner_col).cast("string").alias("owner"), F.col("hash").cast("string").alias("hash")))
        named = fresh.select("owner")
        if removed is not None:
            named = named.union(keep(removed.select(F.col(self.owner_col).cast("string").alias("owner"))))
        if named.isEmpty():
            return version
        own = F.col(self.owner_col).cast("string").alias("owner")
        texts = chunks.select(own, F.col(self.id_col).cast("string").alias("id"), *self.text_cols).join(fresh.select("owner").distinct(), "owner", "left_semi")
        texts, stamp = keep(texts), F.lit(seq).cast("long").alias("seq")
        size = sum(F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in self.text_cols)
        deal = math.ceil((texts.agg(F.sum(size)).first()[0] or 0) / (BYTES_PER_POSTING * POSTINGS_PER_TASK)) or 1
        rows = postings(texts.repartition(deal, "id"), "id", self.text_cols, keep=["owner"])
        self._write_postings(name, rows.select("owner", "term", F.col("field").cast("int"), F.col("position").cast("int"), "id", stamp))
        # Terms are counted where they are written, so texts are taken apart once.
        found = self._read("postings", _POSTINGS, [{"name": name}]).groupBy("owner", "id").agg(F.count("*").cast("int").alias("length"))
        sizes = texts.select("owner", "id").distinct().join(found, ["owner", "id"], "left")
        sizes.select("owner", "id", F.coalesce("length", F.lit(0)).alias("length"), stamp).write.parquet(self._to("lengths", name))
        fresh.select("owner", "hash", stamp).write.parquet(self._to("owners", name))
        segment = self._described(name, seq)
        tombstones = list(entries["tombstones"])
        if entries["segments"]:
            named.distinct().select("owner", F.lit(seq).cast("long").alias("until")).write.parquet(f"{self.root}/tombstones/{name}")
            tombstones.append({"name": name, "until": seq})
        self.versions.commit(version, {"seq": seq, "segments": [*entries["segments"], segment], "tombstones": tombstones})
        return self.merge()

    def merge(self, fan: int = FAN) -> int:
        """Merge segments wherever `fan` of about one size have come together, smallest first; returns the version."""
        version, entries = self.versions.read()
        while True:
            sizes: dict[int, list[dict]] = {}
            for s in entries.get("segments", []):
                sizes.setdefault(int(math.log(max(s["docs"], 1), fan)), []).append(s)
            full = min((size for size, held in sizes.items() if len(held) >= fan), default=None)
            if full is None:
                return version
            version, entries = self._merged(version, entries, sizes[full])

    def compact(self) -> int:
        """All segments to one, without dead rows."""
        version, entries = self.versions.read()
        return self._merged(version, entries, entries["segments"])[0] if len(entries.get("segments", [])) > 1 or entries.get("tombstones") else version

    def _whole(self, part: dict, entries: dict) -> bool:
        """Whether writing a part again would change nothing: its files are of full size and none of its owners is dead."""
        return part["length"] >= POSTINGS_PER_TASK and (not entries["tombstones"] or self._live("owners", _OWNERS, entries, [part]).count() == part.get("owners"))

    def _merged(self, version: int, entries: dict, old: list[dict]) -> tuple[int, dict]:
        name, seq = uuid.uuid4().hex, max(s["seq"] for s in old)
        stamp = F.lit(seq).cast("long").alias("seq")
        parts = [p for s in old for p in self._parts(s)]
        kept = [p for p in parts if self._whole(p, entries)]
        names = {p["name"] for p in kept}
        rest = [p for p in parts if p["name"] not in names]
        if rest:
            live = lambda kind, ddl: self._live(kind, ddl, entries, rest).withColumn("seq", stamp)
            live("lengths", _LENGTHS).write.parquet(self._to("lengths", name))
            live("owners", _OWNERS).write.parquet(self._to("owners", name))
            fresh = self._described(name, seq)
            self._write_postings(name, live("postings", _POSTINGS).repartition(math.ceil(fresh["length"] / POSTINGS_PER_TASK) or 1, "id"))
            kept = [*kept, fresh]
        segment = {"name": name, "docs": sum(p["docs"] for p in kept), "length": sum(p["length"] for p in kept), "seq": seq, "parts": kept}
        gone = {s["name"] for s in old}
        left = [s for s in entries["segments"] if s["name"] not in gone] + [segment]
        # A tombstone concerns segments before it only.
        first = min(s["seq"] for s in left)
        entries = {"seq": entries["seq"], "segments": sorted(left, key=lambda s: s["seq"]), "tombstones": [t for t in entries["tombstones"] if t["until"] > first]}
        return self.versions.commit(version, entries), entries

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that none of the last `keep` versions names."""
        kept = self.versions.forget(keep)
        segments = {f"segment={p['name']}" for e in kept for s in e["segments"] for p in self._parts(s)}
        return sum(self.versions.sweep(kind, segments) for kind in ("postings", "lengths", "owners")) + self.versions.sweep("tombstones", {t["name"] for e in kept for t in e["tombstones"]})

    # Questions

    def matches(self, query: str) -> DataFrame:
        """(id, matches): places where live rows hold the query as a phrase, its last word a prefix."""
        entries = self.entries()
        return phrase_matches(self._live("postings", _POSTINGS, entries), query)

    def totals(self) -> DataFrame:
        """One row (docs, mean_length) of what is live."""
        return self._live("lengths", _LENGTHS, self.entries()).agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length"))

    def bm25(self, query: str, *, clamp: bool = True) -> DataFrame:
        """(id, matches, length, score) as search.bm25 gives them for the live chunks."""
        # The matches, a few numbers for each row that has any, are counted and scored, so they are written once.
        found = Kept(self.spark)(self.matches(query))
        sizes = self._live("lengths", _LENGTHS, self.entries()).select("id", "length")
        stats = F.broadcast(found.agg(F.count("*").alias("with_term")).crossJoin(F.broadcast(self.totals())))
        found = found.join(sizes, "id")
        odds = (F.col("docs") - F.col("with_term") + 0.5) / (F.col("with_term") + 0.5)
        idf = F.greatest(F.ln(odds), F.lit(1e-6)) if clamp else F.ln(odds + 1)
        tf = F.col("matches")
        score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
        return found.crossJoin(stats).withColumn("score", score).select("id", "matches", "length", "score")
