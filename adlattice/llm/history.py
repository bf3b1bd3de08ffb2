"""Deduplicating new batches against all history (problem 6).

Method: multi-key sorted-neighbourhood runs. The index keeps sorted runs of keys in a shared folder, one row
for each key range, bucketed by range, so that the same range of all runs meets in one task without an
exchange. Absorbing a batch signs its texts only, writes its keys as a new sorted run, and merges that run
with each kept run range by range; only the windows of equal keys around new records are compared. Candidates are
verified exactly from the sets kept beside the runs; neither texts nor keys of the history are exchanged or signed again.
Keys are the board-and-id key and the bands of the SuperMinHash signature of the advert. Runs of like size are
merged periodically (``FANOUT`` of them to one), and ranges are halved when they have outgrown their size. A manifest names
the runs, so that an index on disk can be opened again.

Defined results: a record is a repeat if an earlier one (history, or earlier in arrival order) has the
same board and the same id of that board, or an advert of similarity at the threshold or more. NULL or
blank boards or ids have no id key; cut-off JSON still gives its id if that is readable, and its name and
description as far as they go; records without advert (NULL, blank, 'N/A', error marks, residue) are compared by id
only; records without a batch number come after all numbered batches. Empty batches give nothing; extra columns
are ignored; adding the same batch again makes all of its records with an id or an advert repeats.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from adlattice.llm import keyruns as kr
from adlattice.llm import residue
from adlattice.session import cut, release, shared_dir, shuffles_dropped
from adlattice.sources import files

FANOUT = 4


def board_key(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), F.lit(""))


def external_key(c: Column) -> Column:
    """The board's own number without the dress it came in: paths, queries, fragments, prefixes, zero padding, case."""
    t = F.lower(F.trim(c))
    t = F.regexp_replace(t, r"[?#].*$", "")
    t = F.regexp_replace(t, r"^.*/", "")
    t = F.regexp_replace(t, r"^(?:[a-z -]+:|job[_-])+", "")
    return F.nullif(F.regexp_replace(F.trim(t), r"^0+(?=.)", ""), F.lit(""))


def job_records(jobs: DataFrame) -> DataFrame:
    """History rows: their order is before every batch; keys are made negative so that they never meet raw ids."""
    return jobs.select((-F.col("internal_id") - 1).alias("rec"), F.lit(-1).cast("bigint").alias("ord"), board_key(F.col("source")).alias("board"), external_key(F.col("id")).alias("ext"), "name", "description")


ID_TEXT = r'"id"\s*:\s*"((?:[^"\\]|\\.)*)"'


def readable(data: Column, field: str) -> Column:
    """The text of a field as far as a cut-off record holds it; NULL if it does not begin.

    Escaped backslashes and quotes are set aside while the end is sought; half an escape at the end is dropped.
    """
    t = F.regexp_extract(data, rf'(?s)"{field}"\s*:\s*"(.*)$', 1)
    t = F.substring_index(F.replace(F.replace(t, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02")), '"', 1)
    t = F.regexp_replace(t, r"\\(?:u[0-9a-fA-F]{0,3})?$", "")
    t = F.replace(F.replace(t, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    told = F.from_json(F.concat(F.lit('{"t":"'), t, F.lit('"}')), "t string", {"allowUnquotedControlChars": "true"})["t"]
    return F.nullif(told, F.lit(""))


LAST_BATCH = (1 << 15) - 1


def batch_column() -> Column:
    """The number of the batch; records without one come after all numbered batches."""
    return F.coalesce(F.col("batch_no").cast("bigint"), F.lit(LAST_BATCH))


def raw_records(raw: DataFrame) -> DataFrame:
    """Crawl records in order of arrival: batch, then id. A missing external id is taken from the record itself."""
    data = F.col("raw_data")
    item = F.from_json(data, "id string, name string, description string")
    inner = F.coalesce(item["id"], F.nullif(F.regexp_extract(data, ID_TEXT, 1), F.lit("")))
    broken = item["id"].isNull() & item["name"].isNull() & item["description"].isNull()
    name, description = (F.when(broken, readable(data, f)).otherwise(item[f]).alias(f) for f in ("name", "description"))
    ext = F.coalesce(external_key(F.col("external_id")), external_key(inner))
    # batches are small numbers; ids within a batch keep their order in the lower bits
    order = F.shiftleft(batch_column(), 48) + F.col("id")
    return raw.select(F.col("id").alias("rec"), order.alias("ord"), board_key(F.col("source")).alias("board"), ext.alias("ext"), name, description)


STAGE = "kind string, rec bigint, ord bigint, sh bigint, board string, ext string, part int, keys binary, at binary, sets binary, sketch binary, grams binary"
_COLUMNS = [c.split()[0] for c in STAGE.split(", ")]
LINKS = "a bigint, b bigint, earlier boolean"
RECORDS = "rec bigint, ord bigint, sh bigint, board string, ext string"


@dataclass
class Run:
    """A sorted run: its number, its distinct sets (copies across tasks counted again), its records and the files of its keys."""

    number: int
    sets: int
    records: int
    files: list[str]

    @property
    def name(self) -> str:
        return f"run-{self.number:06d}"


class HistoryIndex:
    """An index under ``path``: a manifest, the model, the packed keys of all runs, bucketed by range, and for each run
    ``stage/kind=records`` (every record with board, id and set number) and ``stage/kind=sets`` (the shingle hashes of each
    set); ``met`` holds what each batch had in common with those before it."""

    def __init__(self, spark: SparkSession, model: residue.Model | None = None, path: str | None = None, plan: kr.Plan | None = None, ranges: int = 1, fanout: int = FANOUT):
        self.spark, self.plan, self.ranges, self.splits, self.fanout = spark, plan or kr.Plan(), ranges, 0, fanout
        self.path = path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
        self.runs: list[Run] = []
        self.made = self.version = 0
        self.table: str | None = None
        self.tables: list[str] = []
        self.shared = None
        if model is None:
            raise ValueError("an index needs the model that tells adverts from notices")
        self.model = model
        data = io.BytesIO()
        np.savez(data, weights=model.weights, bias=model.bias)
        files.write_bytes(spark, f"{self.path}/model", data.getvalue())
        self._commit()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HistoryIndex:
        """The index a manifest describes, as another session left it."""
        found = [n for n in files.names(spark, f"{path}/manifest") if n.isdigit()]
        if not found:
            raise FileNotFoundError(f"no index under {path}")
        told = json.loads(files.read_bytes(spark, f"{path}/manifest/{found[-1]}"))
        data = np.load(io.BytesIO(files.read_bytes(spark, f"{path}/model")))
        index = cls.__new__(cls)
        index.spark, index.path, index.table, index.tables, index.shared = spark, path, None, [], None
        index.model = residue.Model(data["weights"], float(data["bias"]))
        index.plan, index.runs = kr.Plan(**told["plan"]), [Run(**r) for r in told["runs"]]
        index.ranges, index.splits, index.fanout, index.made, index.version = told["ranges"], told["splits"], told["fanout"], told["made"], told["version"]
        return index

    def _commit(self) -> None:
        """Write the next manifest; the one before the last goes."""
        self.version += 1
        told = {"plan": asdict(self.plan), "runs": [asdict(r) for r in self.runs], "ranges": self.ranges, "splits": self.splits, "fanout": self.fanout, "made": self.made, "version": self.version}
        files.write_bytes(self.spark, f"{self.path}/manifest/{self.version:09d}", json.dumps(told).encode())
        files.remove(self.spark, f"{self.path}/manifest/{self.version - 2:09d}")

    @property
    def parts(self) -> int:
        return self.ranges << self.splits

    def _next(self) -> int:
        self.made += 1
        return self.made

    @property
    def _folder(self) -> str:
        return f"{self.path}/keys-{self.splits}"

    def _staged(self, runs: list[Run], kind: str, columns: list) -> DataFrame:
        """Rows of one kind of all the runs, by one scan."""
        folders = [f"{self.path}/{r.name}/stage" for r in runs]
        folders = [f"{f}/kind={kind}" for f in folders if f"kind={kind}" in files.names(self.spark, f)]
        schema = STAGE.removeprefix("kind string, ")
        return (self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)).select(*columns)

    def _keys(self, condition: str) -> DataFrame:
        """Packed keys of some runs, from the bucketed table that holds those of all runs."""
        if self.table is None:
            self.table = f"history_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.table} (run int, {kr.STORED}) USING parquet CLUSTERED BY (part) SORTED BY (part) INTO {self.parts} BUCKETS LOCATION '{self._folder}'")
        return self.spark.table(self.table).filter(condition)

    def _tasks(self, sets: int) -> int:
        """Tasks that write a run: one a range, but a single one for no more texts than a range holds anyway."""
        return self.parts if sets > kr.RANGE_TEXTS else 1

    def _write_keys(self, number: int, sets: int, blobs: DataFrame, halve: bool = False) -> list[str]:
        """Merge packed keys to one sorted row a range and store them, a bucket for each range; the names of the files."""
        plan, labels, splits = self.plan, kr.range_labels(self.parts), self.splits
        before = {int(x): i for i, x in enumerate(kr.range_labels(self.parts >> 1))} if halve else {}

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list[kr.Blob]] = {}
            for b in batches:
                for part, stored, *blob in b.itertuples(index=False):
                    held.setdefault(part, []).append(kr.load(*blob, plan) if stored else kr.Blob.of(*blob, plan))
            for part in sorted(held):
                yield pd.DataFrame([(number, part, *kr.dump(kr.merged(held.pop(part))))], columns=["run", "part", "keys", "at", "sets", "sketch"])

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for part, _, *blob in b.itertuples(index=False):
                    rows = [(int(labels[2 * before[part] + bit]), True, *kr.dump(half)) for bit, half in kr.halved(kr.load(*blob, plan), splits - 1)]
                    yield pd.DataFrame(rows, columns=["part", "stored", "keys", "at", "sets", "sketch"])

        if halve:
            blobs = blobs.mapInPandas(split, "part int, stored boolean, keys binary, at binary, sets binary, sketch binary")
        placed = blobs.repartition(self._tasks(sets), "part").mapInPandas(merge, f"run int, {kr.STORED}")
        there = set(files.names(self.spark, self._folder))
        self._keys("true")
        with shuffles_dropped(self.spark):
            placed.write.mode("append").format("parquet").bucketBy(self.parts, "part").sortBy("part").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)
        return [n for n in files.names(self.spark, self._folder) if n not in there and n.endswith(".parquet")]

    def _write(self, records: DataFrame) -> Run:
        """One sorted run of a batch."""
        run = Run(self._next(), 0, 0, [])
        if self.shared is None:
            self.shared = self.spark.sparkContext.broadcast(self.model)
        shared, plan, labels, splits = self.shared, self.plan, kr.range_labels(self.parts), self.splits
        advert = F.when(residue.advert_column(), F.col("description")).alias("description")

        def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = kr.Reader(shared.value, plan)

            def rows(kind: str, **columns: object) -> pd.DataFrame:
                out = pd.DataFrame(columns)
                return out.assign(kind=kind, **{c: 0 for c in ("rec", "ord", "sh", "part") if c not in columns}, **{c: None for c in ("board", "ext", "keys", "at", "sets", "sketch", "grams") if c not in columns})[_COLUMNS]

            for b in batches:
                for i in range(0, len(b), kr.CHUNK):
                    p = b.iloc[i : i + kr.CHUNK]
                    t = reader.read(p["description"].tolist(), p["name"].tolist())
                    yield rows("records", rec=p["rec"].to_numpy(), ord=p["ord"].to_numpy(), sh=np.where(t.good, t.sh, 0), board=p["board"], ext=p["ext"])
                    if t.fresh:
                        yield rows("sets", sh=t.sh[t.fresh], grams=[t.grams(x) for x in t.fresh])
                        part, keys, at, sets, sketch = zip(*reader.packed(t, labels, splits), strict=True)
                        yield rows("keys", part=part, keys=keys, at=at, sets=sets, sketch=sketch)

        folder = f"{self.path}/{run.name}/stage"
        seen = Observation()
        signed = records.select("rec", "ord", "board", "ext", "name", advert).mapInPandas(sign, STAGE)
        counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("sets", "records")]
        signed.observe(seen, *counts).write.partitionBy("kind").option("compression", "zstd").parquet(folder)
        run.sets, run.records = int(seen.get["sets"]), int(seen.get["records"])
        run.files = self._write_keys(run.number, run.sets, self._staged([run], "keys", ["part", F.lit(False).alias("stored"), "keys", "at", "sets", "sketch"]))
        files.remove(self.spark, f"{folder}/kind=keys")
        return run

    def load(self, records: DataFrame) -> None:
        """Take records into the history without reporting."""
        self.runs.append(self._write(records))
        self._settle()

    def candidates(self, run: Run, old: list[Run]) -> DataFrame:
        """``(a, b, earlier)``: a set ``a`` of the new run and a set ``b`` of an older run or, not ``earlier``, of the new run
        itself that share a window; a set the history has too is linked with itself."""
        plan = self.plan
        key = ["keys", "at", "sets", "sketch"]

        def links(found: list[pd.DataFrame], earlier: bool) -> pd.DataFrame:
            return pd.concat([*found, pd.DataFrame({"a": [], "b": []}, dtype="int64")]).drop_duplicates().assign(earlier=earlier)

        def within(rows: pd.DataFrame) -> pd.DataFrame:
            found = [f for r in rows[key].itertuples(index=False) for f in kr.pairs_within(kr.load(*r, plan), plan)]
            return links([*found, *(f.rename(columns={"a": "b", "b": "a"}) for f in found)], False)

        def around(new: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
            mine = [kr.load(*r, plan) for r in new[key].itertuples(index=False)]
            found = [f for r in kept[key].itertuples(index=False) for x in mine for f in kr.pairs_between(x, kr.load(*r, plan), plan)] if mine else []
            return pd.concat([within(new), links(found, True)])

        new = self._keys(f"run = {run.number}").groupBy("part")
        if not old:
            return new.applyInPandas(within, LINKS).distinct()
        kept = self._keys(f"run IN ({', '.join(str(r.number) for r in old)})").groupBy("part")
        return new.cogroup(kept).applyInPandas(around, LINKS).distinct()

    def absorb(self, records: DataFrame) -> int:
        """Add a batch: sign it, merge it with the kept runs, and write down what it has in common with them and in itself.

        Gives the number of the batch, by which :meth:`repeats` answers. Beside the index stand ``met/links`` (verified links
        of its sets with sets of the history or, not ``earlier``, of the batch), ``met/ids`` (its id keys that the history has)
        and ``met/records``; the history is not read again for an answer.
        """
        run, old = self._write(records), list(self.runs)
        mine = self._staged([run], "records", ["rec", "ord", "sh", "board", "ext"])
        found, folder = Observation(), f"{self.path}/{run.name}/links"
        self.candidates(run, old).observe(found, F.count(F.lit(1)).alias("n")).write.parquet(folder)
        links = self.spark.read.schema(LINKS).parquet(folder)
        # the sets at both ends are compared exactly; those of the history are only scanned for the few that are asked for
        n = int(found.get["n"])
        ends = self._staged([*old, run], "sets", ["sh", "grams"]).join(kr.small(links, n), F.col("sh") == F.col("b")).select("a", "b", "earlier", F.col("grams").alias("gb"))
        own = self._staged([run], "sets", [F.col("sh").alias("a"), F.col("grams").alias("ga")]).dropDuplicates(["a"])
        kr.compared(ends.join(own, "a").coalesce(1 + n // kr.RANGE_TEXTS), ["a", "b", "earlier"], self.plan).write.parquet(self._met("links", run.number))
        mine.write.parquet(self._met("records", run.number))
        ids = mine.filter("board IS NOT NULL AND ext IS NOT NULL").select("board", "ext")
        past = self._staged(old, "records", ["board", "ext"]) if old else ids.limit(0)
        past.join(kr.small(ids, run.records), ["board", "ext"], "left_semi").write.parquet(self._met("ids", run.number))
        files.remove(self.spark, folder)
        self.runs.append(run)
        self._settle()
        return run.number

    def _met(self, kind: str, number: int | None = None) -> str:
        return f"{self.path}/met/{kind}" + (f"/batch={number}" if number is not None else "")

    def repeats(self, *numbers: int) -> DataFrame:
        """``(rec)`` of the records of the batches that repeat an earlier one; of all absorbed batches without numbers."""
        chosen = F.col("batch").isin(list(numbers)) if numbers else F.lit(True)
        links, records, ids = (self.spark.read.schema(f"{x}, batch int").parquet(self._met(k)).filter(chosen) for k, x in (("links", LINKS), ("records", RECORDS), ("ids", "board string, ext string")))
        # when each set and id of a batch was met first: -1 stands for the history
        history = F.lit(-1).cast("bigint").alias("ord")
        texts = records.filter("sh <> 0").select("batch", "rec", "ord", F.col("sh").alias("b"))
        inside = links.filter("NOT earlier").select("batch", "a", "b").unionByName(texts.select("batch", F.col("b").alias("a"), "b"))
        first = inside.join(texts.groupBy("batch", "b").agg(F.min("ord").alias("ord")), ["batch", "b"]).select("batch", F.col("a").alias("b"), "ord").unionByName(links.filter("earlier").select("batch", F.col("a").alias("b"), history))
        by_text = texts.join(first.groupBy("batch", "b").agg(F.min("ord").alias("first")), ["batch", "b"]).filter("first < ord").select("rec")
        keyed = records.filter("board IS NOT NULL AND ext IS NOT NULL").select("batch", "rec", "ord", "board", "ext")
        seen = keyed.select("batch", "board", "ext", "ord").unionByName(ids.select("batch", "board", "ext", history)).groupBy("batch", "board", "ext").agg(F.min("ord").alias("first"))
        by_id = keyed.join(seen, ["batch", "board", "ext"]).filter("first < ord").select("rec")
        return cut(by_text.unionByName(by_id).distinct())

    def _settle(self) -> None:
        """Merge runs of like size, halve ranges that have outgrown their size, commit, and remove what no run needs."""
        gone: list[str] = []
        while True:
            levels: dict[int, list[Run]] = {}
            for r in self.runs:
                levels.setdefault(int(np.log(max(1, r.sets) / 256 + 1) / np.log(self.fanout)), []).append(r)
            full = next((levels[x] for x in sorted(levels) if len(levels[x]) >= self.fanout), None)
            if full is None:
                break
            gone += self._merge(full)
        while sum(r.sets for r in self.runs) > 2 * kr.RANGE_TEXTS * self.parts:
            gone += self._halve()
        self._finish(gone)

    def _finish(self, gone: list[str]) -> None:
        self._commit()
        for path in gone:
            files.remove(self.spark, path)
        if gone:
            self.spark.catalog.refreshTable(self.table)

    def _paths(self, runs: list[Run]) -> list[str]:
        return [f"{self.path}/{r.name}" for r in runs] + [f"{self._folder}/{n}" for r in runs for n in r.files]

    def _blobs(self, runs: list[Run]) -> DataFrame:
        return self._keys(f"run IN ({', '.join(str(r.number) for r in runs)})").select("part", F.lit(True).alias("stored"), "keys", "at", "sets", "sketch")

    def _moved(self, runs: list[Run], name: str) -> None:
        """Copy the records and sets of runs into one folder, without an exchange."""
        records, sets = (self._staged(runs, kind, [F.lit(kind).alias("kind"), *_COLUMNS[1:]]) for kind in ("records", "sets"))
        records.unionByName(sets).coalesce(self._tasks(sum(r.sets for r in runs))).write.partitionBy("kind").option("compression", "zstd").parquet(f"{self.path}/{name}/stage")

    def _merge(self, runs: list[Run]) -> list[str]:
        new = Run(self._next(), sum(r.sets for r in runs), sum(r.records for r in runs), [])
        new.files = self._write_keys(new.number, new.sets, self._blobs(runs))
        self._moved(runs, new.name)
        self.runs = [*(r for r in self.runs if r not in runs), new]
        return self._paths(runs)

    def _halve(self) -> list[str]:
        """Rewrite the keys of all runs with twice as many ranges; their other parts stay."""
        old, gone = [(r, self._blobs([r])) for r in self.runs], [self._folder]
        self._forget()
        self.splits += 1
        for r, blobs in old:
            r.files = self._write_keys(r.number, r.sets, blobs, halve=True)
        return gone

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            self._finish(self._merge(list(self.runs)))

    def _forget(self) -> None:
        self.tables, self.table = [*self.tables, *([self.table] if self.table else [])], None

    def close(self, remove: bool = False) -> None:
        """Forget the tables declared in this session; with ``remove`` the index itself goes too."""
        self._forget()
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.tables = []
        if remove:
            files.remove(self.spark, self.path)


def found(jobs: DataFrame, raw: DataFrame, batches_per_step: int = 1, plan: kr.Plan | None = None, fanout: int = FANOUT) -> DataFrame:
    """``(raw_id)`` of the crawl records that bring nothing new.

    ``jobs`` is loaded as the first run; batches are absorbed in their order, ``batches_per_step`` at a time (a step may
    hold several batches, as arrival order decides among its own records). The records are read once and laid down by batch,
    as batches arrive one by one, so that a step does not read those of others.
    """
    spark = jobs.sparkSession
    index = HistoryIndex(spark, residue.fit(jobs), plan=plan, ranges=kr.ranges_for(jobs.count()), fanout=fanout)
    index.load(job_records(jobs))
    arrived = f"{index.path}/arrived"
    records = raw_records(raw).withColumn("batch", F.shiftright("ord", 48))
    records.write.partitionBy("batch").option("compression", "zstd").parquet(arrived)
    numbers = sorted(int(n.removeprefix("batch=")) for n in files.names(spark, arrived) if n.startswith("batch="))
    for i in range(0, len(numbers), batches_per_step):
        release(spark)
        folders = [f"{arrived}/batch={n}" for n in numbers[i : i + batches_per_step]]
        index.absorb(spark.read.schema(records.drop("batch").schema).parquet(*folders))
    out = index.repeats() if numbers else spark.createDataFrame([], "rec bigint")
    index.close(remove=True)
    return out.select(F.col("rec").alias("raw_id"))
