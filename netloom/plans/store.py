"""Results that outlive a run: tables by board, and nets kept by mask contents.

publish() replaces the boards of a run and leaves all others.  Everything is
computed and stored first, so a run that fails leaves the old state; the
manifest, written last, says which tables a board has rows in, so rows of an
older run that has more tables than the new one are not read.

NetCache holds extractions by digest.  A digest covers the pixels of all masks,
the canvas and what the extraction is told, but neither the order of rows nor
how rows are cut into runs, nor the board's number: boards alike are extracted
once.  A run writes its own folder and commits it last.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import masks
from netloom.plans.extract import Extraction
from netloom.storage import stored

BOX = "area_px bigint, x0 int, y0 int, x1 int, y1 int, cx double, cy double"
TABLES = {
    "labels": "board_id int, layer string, y int, x0 int, x1 int, component int",
    "nets": "board_id int, layer string, component int, net int",
    "components": f"board_id int, layer string, component int, {BOX}",
    "drills": f"board_id int, drill int, radius_px double, plated boolean, classification string, rule int, {BOX}",
    "contacts": "board_id int, drill int, layer string, component_ids array<int>, copper_fraction double, pad_ring_fraction double, pad_ring_angular_coverage double, pad_ring_contact boolean, contact string",
    "members": "board_id int, drill int, layer string, component int",
    "canvas": "board_id int, w int, h int",
}
#: What an extraction computes; a new number makes every kept one out of date.
VERSION = 1


def by_board(df: DataFrame, path: str, kind: str = "parquet", *more: str) -> None:
    """Replaces the boards of ``df`` under ``path``/board_id=N, no others; a
    board's layers are written side by side."""
    keys = ["board_id", *(c for c in ("layer",) if c in df.columns)]
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("board_id", *more).format(kind).save(path)


def publish(out: str, name: str, tables: dict[str, DataFrame], boards: DataFrame) -> None:
    """Replaces the rows that ``boards(board_id)`` have in ``tables``; ``name``
    is the manifest's."""
    made = {n: stored(df, n) for n, df in tables.items()}
    held = None
    for n, df in made.items():
        by_board(df, f"{out}/{n}")
        one = df.select("board_id").distinct().withColumn("held", F.lit(n))
        held = one if held is None else held.unionByName(one)
    run = f"{time.time_ns():020d}"
    listed = boards.select("board_id").distinct().join(held, "board_id", "left").groupBy("board_id").agg(F.sort_array(F.collect_set("held")).alias("held"))
    by_board(listed.withColumn("run", F.lit(run)), f"{out}/manifest/{name}")


def table(spark: SparkSession, out: str, name: str, manifest: str = "nets") -> DataFrame:
    """A table of the newest run of each board.  Its schema is named, as an empty
    one has no file to tell it."""
    listed = spark.read.schema("held array<string>, run string, board_id int").parquet(f"{out}/manifest/{manifest}")
    have = listed.where(F.array_contains("held", name)).select("board_id")
    return spark.read.schema(TABLES[name]).parquet(f"{out}/{name}").join(have, "board_id", "left_semi")


def tables_of(e: Extraction) -> dict[str, DataFrame]:
    return dict(
        labels=e.labelled, nets=e.nets, components=e.components, drills=e.decisions.join(e.blobs.drop("radius_px"), ["board_id", "drill"]),
        contacts=e.contacts, members=e.members, canvas=e.canvas.select("board_id", "w", "h"),
    )


def extraction_of(tables: dict[str, DataFrame], copper: DataFrame, drill: DataFrame, layers: tuple[str, ...], mode: str = "infer") -> Extraction:
    """An extraction whose results are read from tables_of() of an earlier one."""
    e = Extraction(copper, drill, tables["canvas"], layers, mode)
    box = [c.split()[0] for c in BOX.split(", ")]
    d = tables["drills"]
    e.__dict__.update(
        labelled=tables["labels"], nets=tables["nets"], components=tables["components"], contacts=tables["contacts"], members=tables["members"],
        decisions=d.select("board_id", "drill", "radius_px", "plated", "classification", "rule"), blobs=d.select("board_id", "drill", "radius_px", *box),
    )
    return e


def mask_digests(runs: DataFrame) -> DataFrame:
    """(board_id, layer, digest) of every mask: SHA-256 of its rows' SHA-256.  A
    group is a row of pixels, then the rows of a mask."""
    span = F.sort_array(F.collect_list(F.struct("x0", "x1")))
    row = masks.merge_runs(runs).groupBy("board_id", "layer", "y").agg(F.sha2(F.array_join(F.transform(span, lambda s: F.concat_ws("-", s["x0"], s["x1"])), ","), 256).alias("digest"))
    rows = F.sort_array(F.collect_list(F.struct("y", "digest")))
    return row.groupBy("board_id", "layer").agg(F.sha2(F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["y"], s["digest"])), ";"), 256).alias("digest"))


def settings(layers: tuple[str, ...], mode: str) -> str:
    return f"{VERSION}|{mode}|{','.join(layers)}"


def board_digests(runs: DataFrame, canvas: DataFrame, told: str) -> DataFrame:
    """(board_id, digest) of every board of ``canvas``; ``told``: settings()."""
    all_ = F.sort_array(F.collect_list(F.struct("layer", "digest")))
    one = mask_digests(runs).groupBy("board_id").agg(F.array_join(F.transform(all_, lambda s: F.concat_ws("=", s["layer"], s["digest"])), ";").alias("masks"))
    text = F.concat_ws("|", F.concat_ws("x", "w", "h"), F.lit(told), F.coalesce("masks", F.lit("")))
    return canvas.join(one, "board_id", "left").select("board_id", F.sha2(text, 256).alias("digest"))


def digest_sql(told: str, masks_sql: str) -> str:
    """DuckDB SQL of board_digests() of the runs that ``masks_sql`` selects."""
    return f"""WITH spans AS ({masks_sql}),
rows_ AS (SELECT board_id, layer, y, sha256(string_agg(x0 || '-' || x1, ',' ORDER BY x0)) AS d FROM spans GROUP BY ALL),
mask AS (SELECT board_id, layer, sha256(string_agg(y || ':' || d, ';' ORDER BY y)) AS d FROM rows_ GROUP BY ALL),
board AS (SELECT board_id, string_agg(layer || '=' || d, ';' ORDER BY layer) AS masks FROM mask GROUP BY board_id)
SELECT board_id, sha256(w || 'x' || h || '|{told}|' || coalesce(masks, '')) AS digest FROM canvas LEFT JOIN board USING (board_id)"""


class NetCache:
    """Extractions by digest in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        """Rows of all runs; none before the first one."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], f"{schema}, run string")
        return self.spark.read.schema(f"{schema}, run string").parquet(f"{self.path}/{name}")

    def known(self) -> DataFrame:
        """(digest, run): the first committed run of each digest."""
        return self._read("commits", "digest string").groupBy("digest").agg(F.min("run").alias("run"))

    def _add(self, e: Extraction, new: DataFrame) -> None:
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables_of(e).items():
            kept = df.join(new, "board_id").drop("board_id")
            kept.repartition("digest").sortWithinPartitions("digest").write.parquet(f"{self.path}/{name}/run={run}")
        new.select("digest").write.parquet(f"{self.path}/commits/run={run}")

    def extract(self, copper: DataFrame, drill: DataFrame, canvas: DataFrame, layers: tuple[str, ...], mode: str = "infer") -> tuple[Extraction, int]:
        """The extraction of all boards, and how many boards had to be labelled:
        one of each digest that no run has committed."""
        cols = ["board_id", "layer", "y", "x0", "x1"]
        runs = copper.select(*cols).unionByName(drill.select(*cols))
        now = stored(board_digests(runs, canvas, settings(layers, mode)), "digests")
        new = stored(now.join(self.known(), "digest", "left_anti").groupBy("digest").agg(F.min("board_id").alias("board_id")), "new")
        n = new.count()
        if n:
            of_new = lambda df: df.join(new.select("board_id"), "board_id", "left_semi")
            self._add(Extraction(of_new(copper), of_new(drill), of_new(canvas), layers, mode), new)
        where = now.join(self.known(), "digest")
        read = lambda name: self._read(name, TABLES[name].replace("board_id int", "digest string", 1)).join(where, ["digest", "run"])
        names = lambda name: [c.split()[0] for c in TABLES[name].split(", ")]
        return extraction_of({name: read(name).select(*names(name)) for name in TABLES}, copper, drill, layers, mode), n
