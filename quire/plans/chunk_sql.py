"""The chunker again, as SQL for another engine: windows and a recursive query. Used to check the Spark form."""

from __future__ import annotations

from ..functions.text import FROM, TO
from ..model import ChunkConfig

_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_CONTROL = r"[\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}]"


def normalize_sql(text: str) -> str:
    quote = lambda s: s.replace("'", "''")
    return f"trim(regexp_replace(regexp_replace(translate(replace({text}, '…', '...'), '{quote(FROM)}', '{quote(TO)}'), '{_CONTROL}', '', 'g'), '{_SPACE}', ' ', 'g'))"


def sentences_sql(normal: str) -> str:
    cut = f"""regexp_replace({normal}, '([.!?][.!?"'')\\]]*)( |$)', '\\1' || chr(1), 'g')"""
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda x: trim(x)), lambda x: length(x) > 0)"


DOCUMENT_BLOCKS = """
b0 AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc, 0 AS page_seq, 1 AS page, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_pos, 'native' AS origin, CAST(NULL AS FLOAT) AS confidence FROM documents
), b AS (SELECT *, block_pos AS block FROM b0)
"""
CONVERSATION_BLOCKS = """
b AS (
  SELECT CAST(conv_id AS VARCHAR) AS doc, turn AS page_seq, turn + 1 AS page, text, 0 AS block_pos, 0 AS block,
         CASE turn % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'synthesized' ELSE 'ocr' END AS origin,
         CASE WHEN turn % 3 = 2 THEN CAST(0.5 + (conv_id % 5) / 10.0 AS FLOAT) END AS confidence FROM conversations
)
"""


def chunk_ctes(blocks: str, cfg: ChunkConfig) -> str:
    """CTEs that end in `chunks` (doc, id, page_start, page_end, text, origin, confidence, hard_split) and `spans` (doc, id, i, page, block)."""
    group = "0" if cfg.cross_page else "page_seq"
    reaches = f"AND NOT (ce - c - 1 >= {cfg.target} AND turns_e)" if cfg.cross_page else ""
    size = max(cfg.max_chars, 1)
    return f"""
WITH RECURSIVE {blocks},
n AS (SELECT *, {normalize_sql("text")} AS t FROM b),
l AS (SELECT *, {sentences_sql("t")} AS ss FROM n WHERE length(t) > 0),
s AS (SELECT doc, {group} AS g, page_seq, page, block_pos, block, origin, confidence, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM l),
i AS (
  SELECT *, length(s) AS n, row_number() OVER w - 1 AS i, coalesce(sum(length(s) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c,
         coalesce(lag(page_seq) OVER w <> page_seq, false) AS turns,
         (sum(length(s) + 1) OVER (PARTITION BY doc, g))::BIGINT AS total, count(*) OVER (PARTITION BY doc, g) AS many
  FROM s WINDOW w AS (PARTITION BY doc, g ORDER BY page_seq, block_pos, pos)
),
r AS (SELECT *, max(i) OVER (PARTITION BY doc, g ORDER BY c RANGE BETWEEN CURRENT ROW AND {cfg.target + 1} FOLLOWING) AS ahead FROM i),
e AS (SELECT *, greatest(i + 1, CASE WHEN total <= c + {cfg.target} + 1 THEN many ELSE ahead END) AS e FROM r),
x AS (
  SELECT e.*, f.n AS n_e, coalesce(f.turns, false) AS turns_e, coalesce(f.c, e.total) AS ce, least({cfg.overlap_sentences}, e.e - e.i) AS k
  FROM e LEFT JOIN e f ON f.doc = e.doc AND f.g = e.g AND f.i = e.e
),
nx AS (
  SELECT *, CASE WHEN n > {cfg.max_chars} THEN i + 1 WHEN e < many AND k > 0 AND e - i > k AND n_e <= {cfg.max_chars} {reaches} THEN e - k ELSE e END AS nx FROM x
),
o AS (
  SELECT doc, g, 0::BIGINT AS i FROM nx WHERE i = 0
  UNION ALL SELECT nx.doc, nx.g, nx.nx FROM o JOIN nx ON nx.doc = o.doc AND nx.g = o.g AND nx.i = o.i WHERE nx.nx < nx.many
),
h AS (SELECT nx.* FROM o JOIN nx USING (doc, g, i)),
soft AS (
  SELECT h.doc, h.g, h.i AS step, 0 AS piece, string_agg(m.s, ' ' ORDER BY m.i) AS text, min(m.page) AS page_start, max(m.page) AS page_end,
         max(CASE m.origin WHEN 'ocr' THEN 2 WHEN 'synthesized' THEN 1 ELSE 0 END) AS rank, min(m.confidence) FILTER (m.origin = 'ocr') AS confidence, false AS hard_split
  FROM h JOIN nx m ON m.doc = h.doc AND m.g = h.g AND m.i >= h.i AND m.i < h.e WHERE h.n <= {cfg.max_chars} GROUP BY h.doc, h.g, h.i
),
p AS (SELECT *, unnest(generate_series(0, CAST(ceil(n / {size}::DOUBLE) AS BIGINT) - 1)) AS piece FROM h WHERE n > {cfg.max_chars}),
hard AS (
  SELECT doc, g, i AS step, piece, substring(s, piece * {size} + 1, {size}) AS text, page AS page_start, page AS page_end,
         CASE origin WHEN 'ocr' THEN 2 WHEN 'synthesized' THEN 1 ELSE 0 END AS rank, CASE WHEN origin = 'ocr' THEN confidence END AS confidence, true AS hard_split FROM p
),
every AS (SELECT * FROM soft UNION ALL SELECT * FROM hard),
chunks AS (
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY g, step, piece) - 1 AS id, page_start, page_end, text,
         ['native', 'synthesized', 'ocr'][rank + 1] AS origin, confidence, hard_split, g, step FROM every
)
"""
