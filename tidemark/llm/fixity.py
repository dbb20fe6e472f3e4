"""Fixity audit of WARC replicas with Merkle trees.

Records of an archive file are hashed; leaves are ordered byte ranges of the file, a record belonging to the range in
which it starts, and each upper node covers FAN consecutive ranges. Roots of two replicas are compared, and only below
nodes that differ are children compared, down to the ranges and then the records that are damaged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read, written

RANGE = 1 << 16  # bytes a leaf covers
FAN = 16
PER_FILE = 4096  # page ids an archive file covers


def records(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(file, record_id, body): a WARC ``resource`` record for every page; a file covers a fixed range of ids.

    Null urls and html are empty; pages without an id make up file -1.
    """
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    ident = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), ident, F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    file = F.coalesce(F.expr(f"page_id div {per_file}"), F.lit(-1).cast("long"))
    return pages.select(file.alias("file"), F.col("page_id").alias("record_id"), F.encode(F.concat(head, html, F.lit("\r\n\r\n")), "UTF-8").alias("body"))


def offsets(recs: DataFrame) -> DataFrame:
    """(file, record_id, nth, start, n_bytes, sha256) in file order: by id, repeats of an id by their content.

    Equal records are one row until the end, and records of one id are dealt by the first byte of their hash, so pages
    without an id or of one id need no task of their own. Sizes are summed by cell before they are added up in order.
    """
    hashed = recs.select("file", "record_id", F.length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha256"))
    same = hashed.groupBy("file", "record_id", "sha256", "n_bytes").agg(F.count("*").alias("c")).withColumn("cell", F.substring("sha256", 1, 2))
    size = F.col("n_bytes") * F.col("c")
    sums = same.groupBy("file", "record_id", "cell").agg(F.sum(size).alias("b"), F.sum("c").alias("n"))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(past(w)), F.lit(0).cast("long"))
    of_file = Window.partitionBy("file").orderBy("record_id", "cell")  # at most PER_FILE ids of at most 256 cells
    of_id = Window.partitionBy("file", "record_id").orderBy("cell")
    before = sums.select(F.col("file").alias("f"), F.col("record_id").alias("i"), F.col("cell").alias("x"), so_far("b", of_file).alias("at"), so_far("n", of_id).alias("seen"))
    rows = same.join(before, (same.file == before.f) & same.record_id.eqNullSafe(before.i) & (same.cell == before.x))
    inside = Window.partitionBy("file", "record_id", "cell").orderBy("sha256")
    rows = rows.select("file", "record_id", "n_bytes", "sha256", (F.col("at") + so_far(size, inside)).alias("at"), (F.col("seen") + so_far(F.col("c"), inside)).alias("seen"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("k"))
    return rows.select("file", "record_id", (F.col("seen") + F.col("k") + 1).cast("int").alias("nth"), (F.col("at") + F.col("k") * F.col("n_bytes")).alias("start"), "n_bytes", "sha256")


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Per level (file, node, hash), ranges first. A node's hash covers its children in order, with their numbers."""
    cell = F.struct((F.col("start") / RANGE).cast("long").alias("node"), "start", "n_bytes", "sha256")
    rows = leaves.select("file", cell.alias("c"))
    parts = F.transform(F.array_sort(F.collect_list("c")), lambda c: F.concat_ws(":", c["start"], c["n_bytes"], c["sha256"]))
    out = [rows.groupBy("file", F.col("c.node").alias("node")).agg(F.sha2(F.array_join(parts, ";"), 256).alias("hash"))]
    for _ in range(levels):
        kids = F.array_sort(F.collect_list(F.struct("node", "hash")))  # at most FAN
        parent = F.expr(f"node div {FAN}")
        joined = F.array_join(F.transform(kids, lambda c: F.concat_ws(":", c["node"], c["hash"])), ";")
        out.append(out[-1].groupBy("file", parent.alias("p")).agg(F.sha2(joined, 256).alias("hash")).withColumnRenamed("p", "node"))
    return out


def damaged_ranges(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file, node) of the leaf ranges that differ between two tables of ``offsets``."""
    size = ours.select("start").union(theirs.select("start")).agg(F.max("start")).first()[0] or 0
    levels = 0
    while size // RANGE >= FAN**levels:
        levels += 1
    a, b = ([written(x, "level") for x in tree(t, levels)] for t in (ours, theirs))

    def differing(level, parents):
        x, y = a[level], b[level].select(F.col("file").alias("f"), F.col("node").alias("n"), F.col("hash").alias("h"))
        if parents is not None:
            x = x.join(parents, (x.file == parents.pf) & (F.expr(f"node div {FAN}") == parents.pn), "left_semi")
            y = y.join(parents, (y.f == parents.pf) & (F.expr(f"n div {FAN}") == parents.pn), "left_semi")
        both = x.join(y, (x.file == y.f) & (x.node == y.n), "full")
        return both.where(~F.col("hash").eqNullSafe(F.col("h"))).select(F.coalesce("file", "f").alias("file"), F.coalesce("node", "n").alias("node"))

    found = differing(levels, None)
    for level in range(levels - 1, -1, -1):
        found = differing(level, found.select(F.col("file").alias("pf"), F.col("node").alias("pn")))
    return found


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every record of either replica with its status against ours: intact, corrupt, moved, missing or extra.

    Columns file, record_id, nth, start, n_bytes, sha256 (of ours, else of theirs), status. Records in ranges whose
    trees agree are intact without being compared. Ids are matched null-safely, repeats of an id one by one.
    """
    ours, theirs = written(ours, "ours"), written(theirs, "theirs")
    bad = written(damaged_ranges(ours, theirs), "ranges").select(F.col("file").alias("bf"), F.col("node").alias("bn"))

    def inside(t, how):
        return t.join(bad, (t.file == bad.bf) & ((t.start / RANGE).cast("long") == bad.bn), how)

    x = inside(ours, "left_semi")
    y = inside(theirs, "left_semi").select(*[F.col(c).alias("t_" + c) for c in theirs.columns])
    on = (F.col("file") == F.col("t_file")) & F.col("record_id").eqNullSafe(F.col("t_record_id")) & (F.col("nth") == F.col("t_nth"))
    status = F.when(F.col("t_file").isNull(), "missing").when(F.col("file").isNull(), "extra").when(F.col("sha256") != F.col("t_sha256"), "corrupt").when(F.col("start") != F.col("t_start"), "moved").otherwise("intact")
    told = x.join(y, on, "full").select(*[F.coalesce(c, "t_" + c).alias(c) for c in ours.columns], status.alias("status"))
    return inside(ours, "left_anti").withColumn("status", F.lit("intact")).unionByName(told)


def damaged(pages: DataFrame) -> DataFrame:
    """The replica that the query audits: pages whose id leaves 7 when divided by 50 have their html reversed."""
    return pages.withColumn("html", F.when(F.col("page_id") % 50 == 7, F.reverse("html")).otherwise(F.col("html")))


def op4_warc_fixity(spark, sf_dir):
    """Every record with its place, digest and status. Null urls and html are empty, pages without an id are in file -1,
    repeated ids are told apart by content; no pages give no rows."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(offsets(records(pages)), offsets(records(damaged(pages)))).drop("nth").withColumnRenamed("record_id", "page_id")


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (
  SELECT page_id, coalesce(page_id // {PER_FILE}, -1) AS file, html, page_id % 50 = 7 AND reverse(html) <> html AS bad,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13) || chr(10)
    || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS body FROM p)
SELECT file, page_id,
  (coalesce(sum(strlen(body)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start,
  strlen(body)::BIGINT AS n_bytes, sha256(body) AS sha256, CASE WHEN bad THEN 'corrupt' ELSE 'intact' END AS status
FROM r
"""
