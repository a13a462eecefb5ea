"""All queries over the driver's tables, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import ChunkConfig
from ..operators import chunk as C
from ..operators import detect, fts, runs
from ..operators.ranking import ranked
from . import blocks as B
from . import chunk_sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table, made in the JVM."""
    names = [f.split()[0] for f in schema.split(", ")]
    shown = lambda v: "null" if v is None else repr(v) if not isinstance(v, str) else "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    values = ", ".join("(" + ", ".join(shown(v) for v in r) + ")" for r in rows)
    kinds = [f.split()[1] for f in schema.split(", ")]
    return spark.sql(f"select {', '.join(f'cast({n} as {k}) as {n}' for n, k in zip(names, kinds, strict=True))} from values {values} as t({', '.join(names)})")


def _values(rows: list[tuple], names: str) -> str:
    """The same literal table for the checking engine."""
    def shown(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\x08", "' || chr(8) || '").replace("\x1c", "' || chr(28) || '") + "'"
        return repr(v)

    return "(VALUES " + ", ".join("(" + ", ".join(shown(v) for v in r) + ")" for r in rows) + f") AS t({names})"


# --- text functions ---------------------------------------------------------------------------------------------

VECTORS = [
    (1, "\u201eTee\u201d, \u201cwarm\u201d; the cook\u2019s \u2018own\u2019 blend"), (2, "7\u20139 p.m. \u2014 bring 3\u2212kg bags"), (3, "later\u2026 or never \u2026"), (4, "\r\n two\t\ttabs   and\n\n\n lines \t"),
    (5, "20\u00a0km\u00a0\u00a0north"), (6, "bell\x07 and\x1b escape"), (7, ""), (8, "\t \r\n"), (9, "smörgåsbord Żubr ψ 東"), (10, "para\u2029graph\u2003wide\u3000ideographic"), (11, "rec\x1eord\x1funit"), (12, "zero\u200bwidth\u200djoin"),
    (13, "Rain fell! Did it stop? It did."), (14, "Version 2.10.7 ships at 9.30 today."), (15, 'Ana asked, "why?" Nobody knew.'), (16, "Étude finie. ¡Ándale! Öl fehlt?"), (17, "Hm.... so?! [Fine.] next"),
]


@_query(f"SELECT id, {S.normalize_sql('text')} AS normal FROM {_values(VECTORS, 'id, text')}")
def q_normalize_vectors(spark, sf_dir):
    return _literals(spark, VECTORS, "id int, text string").select("id", T.normalize("text").alias("normal"))


@_query(f"WITH {S.DOCUMENT_BLOCKS} SELECT doc, block, {S.normalize_sql('text')} AS normal FROM b")
def q_normalize_documents(spark, sf_dir):
    return B.document_blocks(spark, sf_dir).select("doc", F.col("block").cast("long").alias("block"), T.normalize("text").alias("normal"))


@_query(f"SELECT id, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS sentence FROM (SELECT id, {S.sentences_sql(S.normalize_sql('text'))} AS ss FROM {_values(VECTORS, 'id, text')})")
def q_sentences_vectors(spark, sf_dir):
    rows = _literals(spark, VECTORS, "id int, text string")
    return rows.select("id", F.posexplode(T.sentences(T.normalize("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


_SENTENCES = f"""WITH {S.DOCUMENT_BLOCKS}, l AS (SELECT doc, block, {S.sentences_sql(S.normalize_sql('text'))} AS ss FROM b),
s AS (SELECT doc, block, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS s FROM l)"""


@_query(f"{_SENTENCES} SELECT doc, block, pos, s FROM s")
def q_sentences_documents(spark, sf_dir):
    rows = C.sentence_rows(B.document_blocks(spark, sf_dir))
    return rows.select("doc", F.col("block").cast("long").alias("block"), F.col("pos").cast("long").alias("pos"), "s")


@_query(f"{_SENTENCES} SELECT doc, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars, max(length(s)) AS longest FROM s GROUP BY doc")
def q_sentence_stats(spark, sf_dir):
    rows = C.sentence_rows(B.document_blocks(spark, sf_dir)).groupBy("doc")
    return rows.agg(F.count(F.lit(1)).alias("sentences"), F.sum("n").alias("chars"), F.max("n").cast("long").alias("longest"))


HARD = [(1, "é" * 500, 301), (2, "abc", 1), (3, "abcdef", 6), (4, "word " * 130, 300), (5, "xyz", 0)]


@_query(f"SELECT id, k AS piece, substring(text, CAST(k * greatest(size, 1) + 1 AS INT), greatest(size, 1)) AS part FROM (SELECT *, unnest(generate_series(0, CAST(ceil(length(text) / greatest(size, 1)::DOUBLE) AS BIGINT) - 1)) AS k FROM {_values(HARD, 'id, text, size')})")
def q_hard_split_vectors(spark, sf_dir):
    parts = None
    for n, text, size in HARD:
        one = _literals(spark, [(n, text)], "id int, text string").select("id", F.posexplode(T.hard_split("text", size)).alias("piece", "part"))
        parts = one if parts is None else parts.union(one)
    return parts.withColumn("piece", F.col("piece").cast("long"))


PATHS = [(1, "a/b.DOCX"), (2, "x.pdf"), (3, "deep/dir.v2/img.TIFF"), (4, "noext"), (5, "a.tar.gz"), (6, "dir.pdf/file"), (7, "photo.Jpeg")]


@_query(f"SELECT id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('docx','pdf','png','jpg','jpeg','webp','bmp','tif','tiff') AS supported, string_split(path, '/')[-1] AS base FROM {_values(PATHS, 'id, path')}")
def q_path_functions(spark, sf_dir):
    rows = _literals(spark, PATHS, "id int, path string")
    return rows.select("id", T.extension("path").alias("ext"), T.is_supported("path").alias("supported"), T.basename("path").alias("base"))


STYLES = [(1, "Heading1"), (2, "heading 3"), (3, "Heading10"), (4, "Heading"), (5, "Title"), (6, "Heading9"), (7, "HEADING2"), (8, "Heading0"), (9, "Heading2x")]


@_query(f"SELECT id, CASE WHEN try_cast(lv AS INT) BETWEEN 1 AND 9 THEN try_cast(lv AS INT) END AS level FROM (SELECT id, nullif(trim(regexp_extract(style, '^[Hh]eading(.*)$', 1)), '') AS lv FROM {_values(STYLES, 'id, style')})")
def q_heading_levels(spark, sf_dir):
    return _literals(spark, STYLES, "id int, style string").select("id", T.heading_level("style").alias("level"))


# --- blocks and chunks --------------------------------------------------------------------------------------------


@_query(f"WITH {S.DOCUMENT_BLOCKS}, n AS (SELECT doc, page, block, block_pos, {S.normalize_sql('text')} AS t, origin FROM b) SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY block_pos) - 1 AS block, t AS text, origin FROM n WHERE length(t) > 0")
def q_blocks_documents(spark, sf_dir):
    """Blocks as emitted: normalised, blank ones dropped, ids without gaps."""
    from pyspark.sql import Window as W

    rows = B.document_blocks(spark, sf_dir).withColumn("t", T.normalize("text")).where(F.length("t") > 0)
    number = F.row_number().over(W.partitionBy("doc").orderBy("block_pos")) - 1
    return rows.select("doc", "page", number.cast("long").alias("block"), F.col("t").alias("text"), "origin")


_CHUNK_COLUMNS = "doc, id, CAST(page_start AS BIGINT) AS page_start, CAST(page_end AS BIGINT) AS page_end, text, origin, CAST(confidence AS DOUBLE) AS confidence, hard_split"


def _flat(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc", "id", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), "text", "origin", F.col("confidence").cast("double").alias("confidence"), "hard_split")


def _chunk_query(name: str, which: str, cfg: ChunkConfig) -> None:
    source, sql = {"documents": (B.document_blocks, S.DOCUMENT_BLOCKS), "conversations": (B.conversation_blocks, S.CONVERSATION_BLOCKS)}[which]
    _query(f"{S.chunk_ctes(sql, cfg)} SELECT {_CHUNK_COLUMNS} FROM chunks", name)(lambda spark, sf_dir: _flat(C.chunk(source(spark, sf_dir), cfg)))


_chunk_query("q_chunk_documents", "documents", ChunkConfig())
_chunk_query("q_chunk_overlap0", "documents", ChunkConfig(overlap_sentences=0))
_chunk_query("q_chunk_overlap3", "documents", ChunkConfig(overlap_sentences=3))
_chunk_query("q_chunk_small_200_300", "documents", ChunkConfig(200, 300))
_chunk_query("q_chunk_one_sentence", "documents", ChunkConfig(0, 1200))
_chunk_query("q_chunk_conversations_pages", "conversations", ChunkConfig(400, 600))
_chunk_query("q_chunk_conversations_cross", "conversations", ChunkConfig(cross_page=True))
_chunk_query("q_chunk_conversations_cross_small", "conversations", ChunkConfig(60, 200, 2, True))


@_query(f"{S.chunk_ctes(S.DOCUMENT_BLOCKS, ChunkConfig(60, 80))} SELECT doc, count(*) AS chunks, count(*) FILTER (hard_split) AS hard, max(length(text)) AS longest FROM chunks GROUP BY doc")
def q_chunk_hard_split(spark, sf_dir):
    rows = C.chunk(B.document_blocks(spark, sf_dir), ChunkConfig(60, 80)).groupBy("doc")
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.count_if("hard_split").alias("hard"), F.max(F.length("text")).cast("long").alias("longest"))


_REFS = """, spans AS (
  SELECT h.doc, h.g, h.i AS step, 0 AS piece, m.i, m.page, m.block FROM h JOIN nx m ON m.doc = h.doc AND m.g = h.g AND m.i >= h.i AND m.i < h.e WHERE h.n <= {max}
  UNION ALL SELECT doc, g, i, piece, i, page, block FROM p
), ids AS (SELECT doc, g, step, piece, row_number() OVER (PARTITION BY doc ORDER BY g, step, piece) - 1 AS id FROM every),
q AS (
  SELECT ids.doc, ids.id, s.page, s.block, s.i, coalesce(lag(s.page) OVER w = s.page AND lag(s.block) OVER w = s.block, false) AS again
  FROM spans s JOIN ids USING (doc, g, step, piece) WINDOW w AS (PARTITION BY ids.doc, ids.id ORDER BY s.i)
)
SELECT doc, id, row_number() OVER (PARTITION BY doc, id ORDER BY i) - 1 AS nth, CAST(page AS BIGINT) AS page, CAST(block AS BIGINT) AS block FROM q WHERE NOT again"""


def _refs(chunks: DataFrame) -> DataFrame:
    rows = chunks.select("doc", "id", F.posexplode("blocks").alias("nth", "r"))
    return rows.select("doc", "id", F.col("nth").cast("long").alias("nth"), F.col("r.page").cast("long").alias("page"), F.col("r.block").cast("long").alias("block"))


@_query(S.chunk_ctes(S.DOCUMENT_BLOCKS, ChunkConfig()).rstrip() + _REFS.format(max=1200))
def q_chunk_block_refs(spark, sf_dir):
    return _refs(C.chunk(B.document_blocks(spark, sf_dir)))


@_query(S.chunk_ctes(S.CONVERSATION_BLOCKS, ChunkConfig(cross_page=True)).rstrip() + _REFS.format(max=1200))
def q_chunk_block_refs_cross(spark, sf_dir):
    return _refs(C.chunk(B.conversation_blocks(spark, sf_dir), ChunkConfig(cross_page=True)))


@_query(f"{S.chunk_ctes(S.CONVERSATION_BLOCKS, ChunkConfig(cross_page=True))} SELECT origin, count(*) AS chunks, min(CAST(confidence AS DOUBLE)) AS least FROM chunks GROUP BY origin")
def q_chunk_origin(spark, sf_dir):
    rows = C.chunk(B.conversation_blocks(spark, sf_dir), ChunkConfig(cross_page=True)).groupBy("origin")
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.min(F.col("confidence").cast("double")).alias("least"))


EDGE = {
    "tail": ([("A" * 9 + ". " + "B" * 29 + ". " + "C" * 19 + ".", 1)], ChunkConfig(45, 60)),
    "exhausted": ([("X" * 19 + ". " + "Y" * 19 + ".", 1), ("Z" * 9 + ".", 2)], ChunkConfig(41, 60, 1, True)),
    "one_page": ([("X" * 19 + ". " + "Y" * 19 + ". " + "Z" * 9 + ".", 1)], ChunkConfig(41, 60, 1, True)),
    "hard": ([("Ok one. " + "w" * 25 + ". Tail.", 1)], ChunkConfig(10, 10)),
    "letters": ([("Ab c.", 1)], ChunkConfig(0, 0)),
    "zero_target": ([("One here. Two here. Three.", 1)], ChunkConfig(0, 60)),
    "skip_page": ([("One here. Two here.", 1), ("   ", 2), ("Three here.", 7)], ChunkConfig(30, 60, 1, True)),
}


def _edge_blocks(spark: SparkSession, name: str) -> DataFrame:
    rows = [(name, k, p, t) for k, (t, p) in enumerate(EDGE[name][0])]
    flat = _literals(spark, rows, "doc string, page_seq int, page int, text string")
    return flat.selectExpr("doc", "doc as source", "page_seq", "page", "0 as block_pos", "0 as block", "text", "'native' as origin", "cast(null as float) as confidence")


def _edge_sql() -> str:
    parts = []
    for name, (pages, cfg) in EDGE.items():
        rows = [(name, k, p, t) for k, (t, p) in enumerate(pages)]
        blocks = f"b AS (SELECT *, 0 AS block_pos, 0 AS block, 'native' AS origin, CAST(NULL AS FLOAT) AS confidence FROM {_values(rows, 'doc, page_seq, page, text')})"
        parts.append(f"({S.chunk_ctes(blocks, cfg)} SELECT {_CHUNK_COLUMNS} FROM chunks)")
    return " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)


@_query(_edge_sql())
def q_chunk_edge_vectors(spark, sf_dir):
    out = None
    for name, (_, cfg) in EDGE.items():
        one = _flat(C.chunk(_edge_blocks(spark, name), cfg))
        out = one if out is None else out.union(one)
    return out


@_query(f"{S.chunk_ctes(S.DOCUMENT_BLOCKS, ChunkConfig())} SELECT count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text)) AS BIGINT) / count(*)::DOUBLE AS mean_chars, count(*) FILTER (hard_split) AS hard_splits, (SELECT count(*) FROM documents) - count(DISTINCT doc) AS zero_chunk_docs FROM chunks")
def q_corpus_report(spark, sf_dir):
    per = C.chunk(B.document_blocks(spark, sf_dir)).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"), F.count_if("hard_split").alias("h"))
    every = B.read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("docs"))
    total = per.agg(F.sum("n").alias("chunks"), F.sum("c").alias("chars"), F.sum("h").alias("hard_splits"), F.count(F.lit(1)).alias("with_chunks")).crossJoin(every)
    return total.select("chunks", "chars", (F.col("chars").cast("double") / F.col("chunks")).alias("mean_chars"), "hard_splits", (F.col("docs") - F.col("with_chunks")).alias("zero_chunk_docs"))


# --- content addressing and change detection ---------------------------------------------------------------------


@_query("SELECT sha256(text) AS content_hash, count(*) AS paths, CAST(min(octet_length(encode(text))) AS BIGINT) AS byte_size FROM documents GROUP BY 1")
def q_files_by_content(spark, sf_dir):
    docs = B.read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"))
    return docs.groupBy("content_hash").agg(F.count(F.lit(1)).alias("paths"), F.min("size").alias("byte_size"))


_SNAP_SQL = """WITH p0 AS (SELECT 'd' || (doc_id % 7) || CASE WHEN doc_id % 2 = 0 THEN '/sub' ELSE '' END || '/f' || doc_id || '.docx' AS rel_path, * FROM documents),
paths AS (SELECT rel_path, sha256(text) AS content_hash, doc_id * 1000 AS mtime_ns, octet_length(encode(text)) AS byte_size, doc_id FROM p0 WHERE doc_id % 9 <> 0),
files AS (SELECT content_hash, CASE WHEN min(doc_id % 11) = 0 THEN 'failed' ELSE 'indexed' END AS status FROM paths GROUP BY 1),
listing AS (SELECT rel_path, CASE WHEN doc_id % 10 = 0 THEN text || ' edited' ELSE text END AS body, doc_id * 1000 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mtime_ns FROM p0 WHERE doc_id % 13 <> 0),
l AS (SELECT rel_path, octet_length(encode(body)) AS byte_size, mtime_ns, sha256(body) AS content_hash FROM listing),
j AS (
  SELECT coalesce(l.rel_path, p.rel_path) AS rel_path, l.content_hash AS hash, p.content_hash AS old_hash, l.rel_path IS NOT NULL AS listed, p.rel_path IS NOT NULL AS known,
         coalesce(l.byte_size = p.byte_size AND l.mtime_ns = p.mtime_ns, false) AS same, f.status AS old_status, o.content_hash AS owner, o.status AS owner_status
  FROM l FULL OUTER JOIN paths p ON l.rel_path = p.rel_path LEFT JOIN files f ON f.content_hash = p.content_hash LEFT JOIN files o ON o.content_hash = l.content_hash
), a AS (
  SELECT *, CASE WHEN NOT listed THEN 'gone' WHEN known AND same AND old_status = 'indexed' THEN 'unchanged' WHEN known AND same AND NOT {retry} THEN 'skip_failed'
    WHEN {retry} AND owner_status = 'failed' THEN 'parse' WHEN owner IS NULL THEN 'parse' WHEN owner = old_hash THEN 'touch' ELSE 'link' END AS action FROM j
), r AS (
  SELECT *, action = 'parse' AND row_number() OVER (PARTITION BY hash, action ORDER BY string_split(rel_path, '/')) = 1 AS leader FROM a
), s AS (
  SELECT *, CASE WHEN action = 'gone' THEN 'deleted'
    WHEN coalesce(CASE WHEN action IN ('unchanged', 'skip_failed') THEN old_status WHEN action IN ('link', 'touch') THEN owner_status END, '') = 'failed' THEN 'failed'
    WHEN action IN ('unchanged', 'touch') THEN 'unchanged' WHEN action = 'parse' AND known THEN 'modified' ELSE 'new' END AS category FROM r
)"""


def _snap(retry: bool = False) -> str:
    return _SNAP_SQL.format(retry="true" if retry else "false")


def _done(spark, sf_dir, retry=False):
    files, paths = B.stored_snapshot(spark, sf_dir)
    return detect.actions(B.walked_snapshot(spark, sf_dir), paths, files, retry)


@_query(f"{_snap()} SELECT rel_path, action, leader FROM r")
def q_index_actions(spark, sf_dir):
    return _done(spark, sf_dir).select("rel_path", "action", "leader")


@_query(f"{_snap(True)} SELECT rel_path, action, leader FROM r")
def q_index_actions_retry(spark, sf_dir):
    return _done(spark, sf_dir, True).select("rel_path", "action", "leader")


@_query(f"""{_snap()} SELECT count(*) FILTER (leader) AS parsed, count(*) FILTER ((action = 'link' AND owner_status <> 'failed') OR (action = 'parse' AND NOT leader)) AS linked,
count(*) FILTER (action = 'touch') AS touched, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'skip_failed' OR (action = 'link' AND owner_status = 'failed')) AS skipped_failed,
count(*) FILTER (action = 'gone') AS paths_pruned FROM r""")
def q_index_report(spark, sf_dir):
    return detect.report(_done(spark, sf_dir))


@_query(f"{_snap()} SELECT rel_path, category FROM s")
def q_status_listing(spark, sf_dir):
    return detect.status_of(_done(spark, sf_dir))


@_query(f"{_snap()} SELECT category, count(*) AS paths FROM s GROUP BY category")
def q_status_counts(spark, sf_dir):
    return detect.status_of(_done(spark, sf_dir)).groupBy("category").agg(F.count(F.lit(1)).alias("paths"))


@_query(f"{_snap()}, kept AS (SELECT * FROM paths SEMI JOIN l USING (rel_path)), f AS (SELECT * FROM files SEMI JOIN kept USING (content_hash)) SELECT (SELECT count(*) FROM paths) - (SELECT count(*) FROM kept) AS paths_pruned, (SELECT count(*) FROM files) - (SELECT count(*) FROM f) AS files_pruned")
def q_prune(spark, sf_dir):
    files, paths = B.stored_snapshot(spark, sf_dir)
    kept_files, kept = detect.prune(files, paths, B.walked_snapshot(spark, sf_dir))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = count(paths, "a").crossJoin(count(kept, "b")).crossJoin(count(files, "c")).crossJoin(count(kept_files, "d"))
    return rows.select((F.col("a") - F.col("b")).alias("paths_pruned"), (F.col("c") - F.col("d")).alias("files_pruned"))


@_query(f"{_snap()} SELECT p.rel_path, f.content_hash, f.status FROM paths p JOIN files f USING (content_hash)")
def q_paths_fanout(spark, sf_dir):
    files, paths = B.stored_snapshot(spark, sf_dir)
    return paths.join(files, "content_hash").select("rel_path", "content_hash", "status")


@_query("SELECT sha256(text) AS content_hash, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS leader FROM documents")
def q_duplicate_links(spark, sf_dir):
    from pyspark.sql import Window as W

    docs = B.read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return docs.withColumn("leader", F.row_number().over(W.partitionBy("content_hash").orderBy("doc_id")) == 1)


DECISIONS = [(k, kn, ix, sm, rt, own, owner) for k, (kn, ix, sm, rt, own, owner) in enumerate(
    (kn, ix, sm, rt, own, owner) for kn in (False, True) for ix in (False, True) for sm in (False, True) for rt in (False, True) for own in (None, "h1") for owner in (None, "h1", "h2"))]


@_query(f"""SELECT id, CASE WHEN known AND same AND indexed THEN 'unchanged' WHEN known AND same AND NOT retry THEN 'skip_failed' ELSE 'hash' END AS cheap,
CASE WHEN owner IS NULL THEN 'parse' WHEN own = owner THEN 'touch' ELSE 'link' END AS after FROM {_values(DECISIONS, 'id, known, indexed, same, retry, own, owner')}""")
def q_decision_table(spark, sf_dir):
    rows = _literals(spark, DECISIONS, "id int, known boolean, indexed boolean, same boolean, retry boolean, own string, owner string")
    c = F.col
    return rows.select("id", detect.decide_cheap(c("known"), c("indexed"), c("same"), c("retry")).alias("cheap"), detect.decide_after_hash(c("own"), c("owner")).alias("after"))


_EXPORT = S.chunk_ctes(S.DOCUMENT_BLOCKS, ChunkConfig()).rstrip() + """, pp AS (
  SELECT 'd' || (doc_id % 7) || CASE WHEN doc_id % 2 = 0 THEN '/sub' ELSE '' END || '/f' || doc_id || '.docx' AS rel_path, CAST(doc_id AS VARCHAR) AS doc FROM documents)"""


def _paths_of(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").selectExpr(f"{B.PATH} as rel_path", "cast(doc_id as string) as doc")


@_query(_EXPORT + "SELECT rel_path, row_number() OVER (ORDER BY string_split(rel_path, '/')) AS place FROM pp")
def q_export_order(spark, sf_dir):
    return ranked(_paths_of(spark, sf_dir).select("rel_path"), T.path_order("rel_path"), "place")


@_query(_EXPORT + "SELECT rel_path, string_split(rel_path, '/')[-1] AS source, id AS ordinal, text, hard_split FROM pp JOIN chunks USING (doc)")
def q_export_rows(spark, sf_dir):
    chunks = C.chunk(B.document_blocks(spark, sf_dir))
    return _paths_of(spark, sf_dir).join(chunks.drop("source"), "doc").select("rel_path", T.basename("rel_path").alias("source"), F.col("id").alias("ordinal"), "text", "hard_split")


# --- recognition and text runs -----------------------------------------------------------------------------------

_HEAD = "\t".join(f"h{k}" for k in range(12))
TSV = [
    (1, "\n".join([_HEAD, "\t".join(["2"] * 10 + ["-1", ""]), "\t".join(["7"] * 10 + ["64", "stone"]), "\t".join(["7"] * 10 + ["31", "bridge"]), "\t".join(["7"] * 10 + ["85", "1897"])])),
    (2, _HEAD),
    (3, "\n".join([_HEAD, "\t".join(["7"] * 10 + ["n/a", "blur"]), "\t".join(["7"] * 10 + ["72.25", "clear"]), "\t".join(["7"] * 10 + ["99", " \u00a0"])])),
]


@_query(f"""WITH r AS (SELECT id, unnest(string_split(tsv, chr(10))[2:]) AS line FROM {_values([(i, t) for i, t in TSV], 'id, tsv')}),
c AS (SELECT id, try_cast(string_split(line, chr(9))[11] AS FLOAT) AS conf, string_split(line, chr(9))[12] AS word FROM r),
g AS (SELECT id, avg(CAST(conf AS DOUBLE)) FILTER (conf >= 0 AND length(trim(word)) > 0) AS m FROM c GROUP BY id)
SELECT t.id, CAST(coalesce(least(1, greatest(0, m / 100)), 0) AS FLOAT)::DOUBLE AS confidence FROM {_values([(i,) for i, _ in TSV], 'id')} LEFT JOIN g ON g.id = t.id""")
def q_ocr_tsv_confidence(spark, sf_dir):
    rows = _literals(spark, [(i, t.replace("\t", "|")) for i, t in TSV], "id int, tsv string").withColumn("tsv", F.replace("tsv", F.lit("|"), F.lit("\t")))
    return rows.select("id", T.ocr_confidence("tsv").cast("double").alias("confidence"))


@_query(f"{S.chunk_ctes(S.CONVERSATION_BLOCKS, ChunkConfig(400, 600))} SELECT {_CHUNK_COLUMNS} FROM chunks WHERE origin = 'ocr' AND confidence < 0.7::FLOAT")
def q_ocr_low_confidence(spark, sf_dir):
    chunks = C.chunk(B.conversation_blocks(spark, sf_dir), ChunkConfig(400, 600))
    return _flat(chunks.where((F.col("origin") == "ocr") & (F.col("confidence") < F.lit(0.7).cast("float"))))


#: Runs for each rule of merging: pieces of a word, a wide gap, a narrow one, two baselines, overlap, a raised run, spaces at
#: the edges, upright runs, a step back, unlike heights, a blank run between two.
RUNS = [
    ("pieces", 1, 0, "off", 50.0, 400.0, 64.0, 412.0), ("pieces", 1, 1, "ice", 64.5, 400.0, 77.0, 412.0),
    ("wide", 1, 0, "north", 50.0, 400.0, 82.0, 412.0), ("wide", 1, 1, "gate", 86.5, 400.0, 110.0, 412.0),
    ("narrow", 1, 0, "1897", 50.0, 400.0, 76.0, 412.0), ("narrow", 1, 1, ";", 77.25, 400.0, 80.0, 412.0),
    ("rows", 1, 0, "upper", 50.0, 400.0, 80.0, 412.0), ("rows", 1, 1, "lower", 50.0, 383.0, 80.0, 395.0),
    ("cross", 1, 0, "ki", 50.0, 400.0, 63.0, 412.0), ("cross", 1, 1, "te", 61.75, 400.0, 72.0, 412.0),
    ("alone", 1, 0, "margin", 50.0, 400.0, 88.0, 412.0),
    ("raised", 1, 0, "m", 50.0, 400.0, 60.0, 412.0), ("raised", 1, 1, "2", 60.75, 403.0, 65.0, 415.0),
    ("spaced", 1, 0, "iron ", 50.0, 400.0, 72.0, 412.0), ("spaced", 1, 1, "age", 72.0, 400.0, 90.0, 412.0),
    ("upright", 1, 0, "Harbour", 30.0, 200.0, 37.0, 246.0), ("upright", 1, 1, "Street", 37.5, 200.0, 44.5, 240.0),
    ("return", 1, 0, "second", 300.0, 400.0, 340.0, 412.0), ("return", 1, 1, "first", 50.0, 400.0, 78.0, 412.0),
    ("sizes", 1, 0, "BIG", 50.0, 400.0, 95.0, 430.0), ("sizes", 1, 1, "tiny", 99.0, 408.0, 118.0, 421.0),
    ("hollow", 1, 0, "p", 50.0, 400.0, 58.0, 412.0), ("hollow", 1, 1, " \t", 58.0, 90.0, 64.0, 102.0), ("hollow", 1, 2, "q", 58.25, 400.0, 66.0, 412.0),
]


@_query(f"""WITH s AS (SELECT doc, page, seq, text, CAST(x0 AS FLOAT) x0, CAST(y0 AS FLOAT) y0, CAST(x1 AS FLOAT) x1, CAST(y1 AS FLOAT) y1, {S.normalize_sql('text')} AS t FROM {_values(RUNS, 'doc, page, seq, text, x0, y0, x1, y1')}),
k AS (SELECT *, CAST(y1 - y0 AS FLOAT) AS h, CAST((y0 + y1) / 2::FLOAT AS FLOAT) AS mid, text LIKE ' %' AS opens, text LIKE '% ' AS closes, length(t) >= 3 AND y1 - y0 > 2::FLOAT * (x1 - x0) AS vertical FROM s WHERE length(t) > 0),
p AS (SELECT *, lag(h) OVER w AS ph, lag(mid) OVER w AS pm, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(closes) OVER w AS pc, lag(vertical) OVER w AS pv FROM k WINDOW w AS (PARTITION BY doc, page ORDER BY seq)),
g AS (SELECT *, coalesce(NOT vertical AND NOT pv AND abs(pm - mid) <= 0.5::FLOAT * greatest(ph, h) AND x0 >= px0, false) AS goes_on FROM p),
d AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page ORDER BY seq) - 1 AS block, CASE WHEN goes_on AND (pc OR opens OR x0 - px1 > 0.2::FLOAT * least(ph, h)) THEN ' ' || t ELSE t END AS piece FROM g)
SELECT doc, page, CAST(block AS INTEGER) AS block, string_agg(piece, '' ORDER BY seq) AS text, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1 FROM d GROUP BY doc, page, block""")
def q_pdf_merge_runs(spark, sf_dir):
    lines = runs.merge_runs(_literals(spark, RUNS, "doc string, page int, seq int, text string, x0 float, y0 float, x1 float, y1 float"))
    return lines.select("doc", "page", "block", "text", *(F.col(f"bbox.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))


# --- term lookup -------------------------------------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}\\p{Co}]+')"
_POSTINGS = f"{S.chunk_ctes(S.CONVERSATION_BLOCKS, ChunkConfig(400, 600)).rstrip()}, po AS (SELECT doc, id, unnest({_TOKENS}) AS term, generate_subscripts({_TOKENS}, 1) - 1 AS pos FROM chunks)"


def _index(spark, sf_dir):
    return fts.postings(C.chunk(B.conversation_blocks(spark, sf_dir), ChunkConfig(400, 600)), ["doc", "id"])


@_query(f"{_POSTINGS} SELECT term, doc, id, pos FROM po")
def q_fts_postings(spark, sf_dir):
    return _index(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))


@_query(f"{_POSTINGS} SELECT doc, id, count(*) AS hits FROM po WHERE term = 'the' GROUP BY doc, id")
def q_fts_term(spark, sf_dir):
    return fts.match_term(_index(spark, sf_dir), "The", ["doc", "id"])


@_query(f"{_POSTINGS} SELECT doc, id, count(*) AS hits FROM po WHERE starts_with(term, 'ther') GROUP BY doc, id")
def q_fts_prefix(spark, sf_dir):
    return fts.match_prefix(_index(spark, sf_dir), "thér", ["doc", "id"])


@_query(f"{_POSTINGS} SELECT a.doc, a.id, count(*) AS hits FROM po a JOIN po b ON a.doc = b.doc AND a.id = b.id AND b.pos = a.pos + 1 AND a.term = 'of' AND b.term = 'the' GROUP BY a.doc, a.id")
def q_fts_phrase(spark, sf_dir):
    return fts.match_phrase(_index(spark, sf_dir), "of the", ["doc", "id"])
