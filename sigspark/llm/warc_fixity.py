"""WARC archives and a Merkle fixity audit of their replicas.

A shard is a WARC file of gzip records.  The hash of a record's offset range and stored bytes is a leaf, and so is that of
what a file has behind its last record; ``FANOUT`` neighbours in offset order make a node, whose hash is of its range, from
its first offset to its last end, and its children's hashes, up to one root for each shard, and shards are gathered
likewise up to the root of the archive.  Two replicas are compared from the root: only the children of a node whose
hashes differ are looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm import storage

FANOUT = 16
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 4 << 20  # records are read in runs of about so many bytes
INDEX = "shard int, seq long, offset long, length long, page_id long, path string"


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """A gzip member that holds a WARC resource record; nulls count as empty."""
    body = (html or "").encode("utf-8")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = {
        "WARC-Type": "resource",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(body).hexdigest()}",
        "Content-Type": "text/html",
        "Content-Length": str(len(body)),
    }
    plain = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(plain.encode("utf-8") + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(stored: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields and the block of a stored record."""
    head, _, rest = gzip.decompress(stored).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_warc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as WARC shards under ``folder``; returns the index: shard, seq, offset, length, page_id, path.

    Each partition of ``pages`` is a shard.  Nulls are stored as empty; repeated rows are records of their own; an
    empty table gives no record; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        path = f"{folder}/shard-{shard:06d}.warc.gz"
        rows: list[tuple] = []
        seq = 0
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.string()]

        def indexed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with storage.committed(path) as out:
            batch: pa.RecordBatch | None = first
            while batch is not None:
                for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    stored = record(page_id, url.as_py(), html.as_py())
                    out.write(stored)
                    rows.append((shard, seq, at, len(stored), page_id, path))
                    seq += 1
                    at += len(stored)
                    if len(rows) == 1 << 16:
                        yield indexed()
                batch = next(batches, None)
        if rows:
            yield indexed()

    named = pages.select(storage.col(id_col).cast("long").alias("page_id"), storage.col(url_col).alias("url"), storage.col(html_col).alias("html"))
    return storage.materialize(storage.map_batches(named, run, INDEX), "warc-index")


def copy_with_faults(index: DataFrame, folder: str, flip: Column) -> DataFrame:
    """A replica of an archive under ``folder`` in which the records with ``flip`` have one bit changed: shard, path.

    It stands for the decay that an audit looks for, and is what tests and the demonstration query audit.  A record of a
    null ``flip``, or of no bytes, stays as it is; an empty index gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source, path = storage.open_fs(row["path"])
                to = f"{folder}/{path.rsplit('/', 1)[1]}"
                marks, at = sorted(row["marks"]), 0
                with source.open_input_file(path) as file, storage.committed(to) as out:
                    for mark in [*marks, file.size()]:
                        while at < mark:
                            chunk = file.read_at(min(1 << 20, mark - at), at)
                            out.write(chunk)
                            at += len(chunk)
                        if at < file.size():
                            out.write(bytes([file.read_at(1, at)[0] ^ 1]))
                            at += 1
                yield pa.RecordBatch.from_pydict({"shard": pa.array([row["shard"]], pa.int32()), "path": [to]})

    # The changed bit is in the middle of the record; the marks of a shard are bounded by its records.
    marks = index.groupBy("shard", "path").agg(F.collect_list(F.when(flip, F.col("offset") + (F.col("length") / 2).cast("long"))).alias("marks"))
    return storage.materialize(storage.map_batches(marks, run, "shard int, path string"), "warc-replica")


class _Runs:
    """Ranges of a file that are asked for in rising order, read ``READ_BYTES`` at a time."""

    def __init__(self, path: str):
        files, inside = storage.open_fs(path)
        self.file = files.open_input_file(inside)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def get(self, offset: int, length: int) -> bytes:
        """The bytes that there are of a range."""
        length = max(0, min(length, self.size - offset))
        if offset < self.at or offset + length > self.at + len(self.held):
            self.at, self.held = offset, self.file.read_at(max(length, min(READ_BYTES, self.size - offset)), offset) if length else b""
        return self.held[offset - self.at : offset - self.at + length]

    def close(self) -> None:
        self.file.close()

    def rest(self, offset: int) -> str:
        """The hash of all that stands at ``offset`` and behind it, a part at a time."""
        digest = hashlib.sha256()
        while part := self.get(offset, READ_BYTES):
            digest.update(part)
            offset += len(part)
        return digest.hexdigest()


def hash_records(index: DataFrame, replica: DataFrame) -> DataFrame:
    """The leaves of a replica: shard, seq, page_id, offset, length, hash of the bytes stored at each record's place.

    ``replica`` has shard and path.  One more leaf of each shard, behind its last record and of length 0 in the index,
    holds what the file has there.  Bytes that are missing in the file leave what there is to be hashed; a missing
    shard has the hash ``missing``; an empty index gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str | None, _Runs | None] = (None, None)
        for batch in batches:
            hashes = []
            for path, offset, length, tail in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length", "tail")), strict=True):
                if path is not None and opened[0] != path:
                    if opened[1]:
                        opened[1].close()
                    try:
                        opened = (path, _Runs(path))
                    except FileNotFoundError:
                        opened = (path, None)
                file = opened[1] if path is not None else None
                if file is None:
                    hashes.append("missing")
                else:
                    hashes.append(file.rest(offset) if tail else hashlib.sha256(file.get(offset, length)).hexdigest())
            kept = ("shard", "seq", "page_id", "offset", "length")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(hashes, pa.string())], names=[*kept, "hash"])
        if opened[1]:
            opened[1].close()

    records = index.select("shard", "seq", "page_id", "offset", "length", F.lit(False).alias("tail"))
    tails = index.groupBy("shard").agg((F.max("seq") + 1).alias("seq"), F.max(F.col("offset") + F.col("length")).alias("offset"))
    rows = records.unionByName(tails.select("shard", "seq", F.lit(None).cast(dict(index.dtypes)["page_id"]).alias("page_id"), "offset", F.lit(0).cast("long").alias("length"), F.lit(True).alias("tail")))
    rows = rows.join(replica.select("shard", "path"), "shard", "left")
    # Runs of a shard's records stay together, whatever a shard's size.
    spread = rows.repartition("shard", F.floor(F.col("seq") / 4096)).sortWithinPartitions("shard", "seq")
    return storage.map_batches(spread, run, f"shard int, seq long, page_id {dict(index.dtypes)['page_id']}, offset long, length long, hash string")


class Level(NamedTuple):
    """Nodes of one height: grp, node, start, end, hash, and of leaves page_id.  ``gathers``: its nodes' children are the roots of shards."""

    nodes: DataFrame
    gathers: bool = False


def merkle_levels(leaves: DataFrame, name: str) -> list[Level]:
    """The levels of a replica's tree, leaves first.

    Up to a shard's root grp is the shard; from there up it is -1 and nodes are runs of shards.  A hash is of the node's
    range too, so bytes that have moved differ.  No leaves give levels without nodes.
    """

    def ranged(content: Column) -> Column:
        return F.sha2(F.concat_ws(",", "start", "end", content), 256)

    first = leaves.select(F.col("shard").cast("long").alias("grp"), F.col("seq").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), "hash", "page_id")
    first = first.withColumn("hash", F.when(F.col("hash") == "missing", F.col("hash")).otherwise(ranged(F.col("hash"))))
    levels = [Level(storage.materialize(first, f"{name}-leaves"))]

    def climb() -> None:
        most = (levels[-1].nodes.agg(F.max("node").alias("m")).first()["m"] or 0) + 1
        while most > 1:
            ordered = F.sort_array(F.collect_list(F.struct("node", "hash")))
            joined = F.concat_ws(",", F.transform(ordered, lambda x: x["hash"]))
            above = levels[-1].nodes.groupBy("grp", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.min("start").alias("start"), F.max("end").alias("end"), joined.alias("hash")).withColumn("hash", ranged(F.col("hash")))
            levels.append(Level(storage.materialize(above, f"{name}-nodes")))
            most = -(-most // FANOUT)

    climb()
    roots = levels[-1].nodes.select(F.lit(-1).cast("long").alias("grp"), F.col("grp").alias("node"), F.lit(0).cast("long").alias("start"), "end", "hash")
    levels.append(Level(roots, gathers=True))
    climb()
    return levels


def audit(ours: list[Level], theirs: list[Level]) -> DataFrame:
    """Descend two trees of the same index and return the records whose bytes differ.

    Returns page_id, shard, seq, offset, length, ours, theirs (hashes of a record's range and bytes).  Only children of
    differing nodes are compared, on both sides.  Every level grows with the pages, so none is broadcast.  Bytes behind a
    shard's last record give a row of page_id null and length 0; repeated pages are records of their own; two empty trees
    give no row.
    """
    wanted = None

    def children(k: int, nodes: DataFrame) -> DataFrame:
        if wanted is None:
            return nodes
        parent = [F.lit(-1).cast("long").alias("grp"), F.col("grp").alias("node")] if ours[k + 1].gathers else [F.col("grp"), F.floor(F.col("node") / FANOUT).alias("node")]
        return nodes.withColumn("up", F.struct(*parent)).join(wanted.hint("merge"), "up", "left_semi").drop("up")

    for k in range(len(ours) - 1, -1, -1):
        other = children(k, theirs[k].nodes.select("grp", "node", F.col("hash").alias("other")))
        differ = children(k, ours[k].nodes).join(other.hint("merge"), ["grp", "node"], "left").where("not (hash <=> other)")
        wanted = storage.materialize(differ.select(F.struct("grp", "node").alias("up")), "fixity-differ") if k else None
    length = (F.col("end") - F.col("start")).alias("length")
    return differ.select("page_id", F.col("grp").cast("int").alias("shard"), F.col("node").alias("seq"), F.col("start").alias("offset"), length, F.col("hash").alias("ours"), F.col("other").alias("theirs"))


def archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write pages into the shared folder; the index, and the replica table (shard, path) of what was written."""
    index = write_warc(pages, storage.new_dir(pages.sparkSession, "warc"))
    return index, index.select("shard", "path").distinct()
