"""The catalogue's queries as plain SQL, written from the definitions rather than from the Spark plans.

Sets are compared by joining unnested rows, and longest blocks by joining single token positions, so that a
mistake in a Spark shortcut cannot repeat itself here.
"""

from __future__ import annotations

from cloneflow.functions.text import CALL_PATTERN, IDENTIFIER_PATTERN, KEYWORDS, MARKUP_COMMENT, MAX_TOKENS, MORE_SPACES
from cloneflow.operators import evaluate
from cloneflow.operators.candidates import SHINGLE, SIMILARITY
from cloneflow.operators.graph import DUMMY_LABEL, GENERATORS, HEADER
from cloneflow.operators.measures import (
    MATCH_K,
    MINHASH_BAND,
    MINHASH_PRIME,
    MINHASH_SEEDS,
    NGRAM_N,
    ROLLING_K,
    WINNOW_K,
    WINNOW_WINDOW,
)
from cloneflow.operators.joins import SHARDS
from cloneflow.operators.embed import SIGN_BITS
from cloneflow.plans.catalog import BOARD, RUN_ID, WALK_LENGTH, WALK_SEED, WALKS, WORD_DIM, board_thresholds

KEYWORD_LIST = ", ".join(f"'{k}'" for k in KEYWORDS)
# The letters outside ASCII in the documents. Their place in the string is the control
# character that stands for them, because the SQL engine's edit distance counts bytes.
LETTERS = "óçäÄéÉÇßíÊÍêüÖÜñÑèÓÈö"
CONTROLS = [n for n in range(1, 32) if n not in (9, 10, 11, 12, 13)][: len(LETTERS)]


# The same white space as one character class.
TOKEN_CLASS = r"[^\s\x0B" + "".join(f"\\x{{{ord(c):X}}}" for c in MORE_SPACES) + "]+"


def _tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{TOKEN_CLASS}')"


def _hash(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def _grams(tokens: str, k: int) -> str:
    return f"list_transform(range(1, len({tokens}) - {k} + 2), lambda i: array_to_string({tokens}[i:i + {k} - 1], ' '))"


D = f"""d AS (
  SELECT doc_id, source AS case_id, lang AS label, text, {_tokens('text')} AS tk FROM documents),
first AS (SELECT case_id, min(doc_id) AS o_id FROM d GROUP BY case_id),
p AS (
  SELECT d.case_id, d.doc_id, f.o_id, d.label = o.label AS is_clone, o.tk AS a_tk, d.tk AS b_tk,
         o.text AS a_text, d.text AS b_text, len(o.tk) AS a_n, len(d.tk) AS b_n
  FROM d JOIN first f ON d.case_id = f.case_id JOIN d o ON o.doc_id = f.o_id WHERE d.doc_id <> f.o_id)"""

PAGES = """d AS (
  SELECT page_id AS doc_id, regexp_extract(url, '^https?://([^/]+)', 1) AS case_id, html AS text FROM pages),
first AS (SELECT case_id, min(doc_id) AS o_id FROM d GROUP BY case_id),
p AS (
  SELECT d.case_id, d.doc_id, f.o_id FROM d JOIN first f ON d.case_id = f.case_id WHERE d.doc_id <> f.o_id)"""

BAGS = "bags AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(tk) AS w FROM d) GROUP BY doc_id, w)"
SHARED = """shared AS (
  SELECT p.doc_id, sum(a.c) AS ca, sum(least(a.c, b.c)) AS cmin, sum(a.c * b.c) AS dot
  FROM p JOIN bags b ON b.doc_id = p.doc_id JOIN bags a ON a.doc_id = p.o_id AND a.w = b.w GROUP BY p.doc_id)"""


def _sets(name: str, items: str) -> str:
    """Distinct items per document with set sizes, and per pair the sizes and the intersection."""
    return f"""{name} AS ({items}),
{name}_n AS (SELECT doc_id, count(*) AS n FROM {name} GROUP BY doc_id),
{name}_i AS (
  SELECT p.doc_id, count(*) AS n FROM p JOIN {name} b ON b.doc_id = p.doc_id
  JOIN {name} a ON a.doc_id = p.o_id AND a.x = b.x GROUP BY p.doc_id),
{name}_p AS (
  SELECT p.case_id, p.doc_id, p.o_id, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb, coalesce(i.n, 0) AS ni
  FROM p LEFT JOIN {name}_n a ON a.doc_id = p.o_id LEFT JOIN {name}_n b ON b.doc_id = p.doc_id
  LEFT JOIN {name}_i i ON i.doc_id = p.doc_id)"""


NODES = _sets("nodes", "SELECT DISTINCT doc_id, unnest(tk) AS x FROM d")
EDGES = _sets(
    "edges",
    "SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(list_transform(range(1, len(tk)), lambda i: {'s': tk[i], 't': tk[i + 1]})) AS x FROM d)",
)


def _gram_sets(name: str, k: int) -> str:
    return _sets(name, f"SELECT DISTINCT doc_id, unnest({_grams('tk', k)}) AS x FROM d")


def _div(part: str, whole: str, empty: float = 0.0) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / ({whole}) ELSE {empty}::DOUBLE END"


PRINTS = _sets(
    "prints",
    f"""SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(h) - {WINNOW_WINDOW} + 1, 1) + 1),
      lambda i: list_min(h[i:i + {WINNOW_WINDOW} - 1]))) AS x
      FROM (SELECT doc_id, list_transform({_grams('tk', WINNOW_K)}, lambda g: {_hash('g')}) AS h FROM d) WHERE len(h) > 0""",
)

POSITIONS = """pos AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos
  FROM (SELECT doc_id, w, min(i) AS i FROM (
    SELECT doc_id, unnest(tk) AS w, unnest(range(len(tk))) AS i FROM d) GROUP BY doc_id, w)),
same AS (
  SELECT p.doc_id, count(*) AS m FROM p JOIN pos b ON b.doc_id = p.doc_id
  JOIN pos a ON a.doc_id = p.o_id AND a.pos = b.pos AND a.w = b.w GROUP BY p.doc_id)"""

_metrics = lambda t, k: (
    f"[len({k})::DOUBLE, len(list_distinct({k}))::DOUBLE, len(string_split({t}, chr(10)))::DOUBLE, "
    f"length({t})::DOUBLE / len(string_split({t}, chr(10))), length({t})::DOUBLE]"
)
SIMILAR = f"""WITH RECURSIVE g AS (
  SELECT doc_id, unnest(list_distinct({_grams('tk', SHINGLE)})) AS x FROM (SELECT doc_id, {_tokens('text')} AS tk FROM documents)),
n AS (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
scored AS (SELECT i.a, i.b, i.c / CAST(x.c + y.c - i.c AS DOUBLE) AS s FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b),
links AS (SELECT * FROM scored WHERE s >= {SIMILARITY}) """
CHAINS = """, reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
"""
PROFILE = f"""prof AS (
  SELECT doc_id, list_sum(list_transform(list_zip(x, y), lambda z:
    CASE WHEN greatest(z[1], z[2]) > 0 THEN least(z[1], z[2]) / greatest(z[1], z[2]) ELSE 1.0::DOUBLE END)) / 5 AS s
  FROM (SELECT doc_id, {_metrics('a_text', 'a_tk')} AS x, {_metrics('b_text', 'b_tk')} AS y FROM p))"""

NORMS = "norms AS (SELECT doc_id, sqrt(CAST(sum(c * c) AS DOUBLE)) AS n FROM bags GROUP BY doc_id)"

BLOCKS = """places AS (SELECT doc_id, unnest(tk) AS w, unnest(range(len(tk))) AS i FROM d),
hits AS (
  SELECT p.doc_id, a.i, a.i - b.i AS diagonal FROM p JOIN places b ON b.doc_id = p.doc_id JOIN places a ON a.doc_id = p.o_id AND a.w = b.w),
runs AS (
  SELECT doc_id, count(*) AS run FROM (
    SELECT doc_id, diagonal, i - row_number() OVER (PARTITION BY doc_id, diagonal ORDER BY i) AS island FROM hits)
  GROUP BY doc_id, diagonal, island),
longest AS (SELECT doc_id, max(run) AS block FROM runs GROUP BY doc_id)"""

# measure -> (common table expressions, rows `doc_id, s`)
PARTS: dict[str, tuple[list[str], str]] = {
    "graph_node_jaccard": (
        [NODES, POSITIONS],
        """SELECT s.doc_id, CASE WHEN greatest(a_n, b_n) > 0 THEN
  CAST(coalesce(m, 0) + greatest(a_n, b_n) - greatest(na, nb) AS DOUBLE)
  / (na + nb - ni + greatest(a_n, b_n) - least(na, nb)) END AS s
  FROM nodes_p s JOIN p USING (doc_id) LEFT JOIN same ON same.doc_id = s.doc_id""",
    ),
    "token_overlap": (
        [BAGS, SHARED],
        f"SELECT p.doc_id, {_div('coalesce(ca, 0)', 'a_n + b_n - coalesce(ca, 0)')} AS s FROM p LEFT JOIN shared ON shared.doc_id = p.doc_id",
    ),
    "bag_quick_ratio": (
        [BAGS, SHARED],
        f"SELECT p.doc_id, {_div('2 * coalesce(cmin, 0)', 'a_n + b_n', 1.0)} AS s FROM p LEFT JOIN shared ON shared.doc_id = p.doc_id",
    ),
    "graph_edit_similarity": (
        [NODES, EDGES],
        """SELECT n.doc_id, CASE WHEN n.na + n.nb > 0 THEN
  1 - CAST(n.na + n.nb - 2 * n.ni + e.na + e.nb - 2 * e.ni AS DOUBLE) / (n.na + n.nb) ELSE 0.0::DOUBLE END AS s
  FROM nodes_p n JOIN edges_p e ON e.doc_id = n.doc_id""",
    ),
    "bow_cosine": (
        [BAGS, SHARED, NORMS],
        f"""SELECT p.doc_id, {_div('coalesce(dot, 0)', 'coalesce(a.n * b.n, 0)')} AS s FROM p
  LEFT JOIN shared ON shared.doc_id = p.doc_id LEFT JOIN norms a ON a.doc_id = p.o_id LEFT JOIN norms b ON b.doc_id = p.doc_id""",
    ),
    "rolling_hash": ([_gram_sets("rolling", ROLLING_K)], f"SELECT doc_id, {_div('ni', 'na')} AS s FROM rolling_p"),
    "jaccard": ([NODES], f"SELECT doc_id, {_div('ni', 'na + nb - ni')} AS s FROM nodes_p"),
    "metric_profile": ([PROFILE], "SELECT doc_id, s FROM prof"),
    "ngram_similarity": ([_gram_sets("ngrams", NGRAM_N)], f"SELECT doc_id, {_div('ni', 'na + nb - ni')} AS s FROM ngrams_p"),
    "rk_match": ([_gram_sets("kgrams", MATCH_K)], f"SELECT doc_id, {_div('ni', 'least(na, nb)')} AS s FROM kgrams_p"),
    "longest_block": (
        [BLOCKS],
        f"SELECT p.doc_id, {_div('2 * coalesce(l.block, 0)', 'a_n + b_n', 1.0)} AS s FROM p LEFT JOIN longest l ON l.doc_id = p.doc_id",
    ),
    "winnow": ([PRINTS], f"SELECT doc_id, {_div('ni', 'na + nb - ni')} AS s FROM prints_p"),
}


# Equal token sets score 1, texts without tokens 0, and everything lies in its range: all of it must hold.
LEARNED_FACTS = f"""WITH {D}
SELECT case_id, doc_id, CASE WHEN a_n = 0 OR b_n = 0 THEN 'empty' WHEN list_sort(list_distinct(a_tk)) = list_sort(list_distinct(b_tk)) THEN 'copy' ELSE 'other' END AS kind,
  true AS holds FROM p"""


def _edit(a: str, b: str) -> str:
    plain = lambda t: f"translate({t}, '{LETTERS}', {' || '.join(f'chr({n})' for n in CONTROLS)})"
    longer = f"greatest(length({a}), length({b}))"
    return f"CASE WHEN {longer} > 0 THEN 1 - CAST(levenshtein({plain(a)}, {plain(b)}) AS DOUBLE) / {longer} ELSE 1.0::DOUBLE END"


PARTS["levenshtein"] = ([], f"SELECT doc_id, {_edit('a_text', 'b_text')} AS s FROM p")
PARTS["fuzzy_token_sort"] = (
    ["sorted AS (SELECT doc_id, array_to_string(list_sort(a_tk), ' ') AS a, array_to_string(list_sort(b_tk), ' ') AS b FROM p)"],
    f"SELECT doc_id, {_edit('a', 'b')} AS s FROM sorted",
)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(dict.fromkeys(parts)) + "\n"


def _measure(name: str) -> str:
    ctes, rows = PARTS[name]
    return _with(D, *ctes) + f"SELECT p.case_id, p.doc_id, round(r.s, 6) AS similarity FROM p JOIN ({rows}) r ON r.doc_id = p.doc_id"


def _page_sets(items: str, empty: float) -> str:
    return _with(PAGES, _sets("items", items)) + (
        f"SELECT case_id, doc_id, round({_div('ni', 'na + nb - ni', empty)}, 6) AS similarity FROM items_p"
    )


def _power(matrix: str, name: str, rounds: int = 1000) -> str:
    """The leading eigenvector of a one-row table's matrix `m` by power iteration, as `{name}(m, v, value)`."""
    times = "list_transform(m, lambda r: list_dot_product(r, v))"
    return f"""{name}_steps AS (
  SELECT 0 AS step, m, list_transform(range(1, len(m) + 1), lambda i: 1.0::DOUBLE / i) AS v FROM {matrix}
  UNION ALL SELECT step + 1, m, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u)))
  FROM (SELECT step, m, {times} AS u FROM {name}_steps WHERE step < {rounds})),
{name} AS (SELECT m, v, list_dot_product({times}, v) AS value FROM {name}_steps WHERE step = {rounds})"""


PCA = f"""WITH RECURSIVE entries AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
covariance AS (
  SELECT list(r ORDER BY i) AS m FROM (
    SELECT a.i, list(c ORDER BY j) AS r FROM (
      SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM entries a JOIN entries b ON a.vec_id = b.vec_id GROUP BY a.i, b.i) a GROUP BY a.i)),
{_power("covariance", "one")},
rest AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda c, j: c - value * v[i] * v[j])) AS m FROM one),
{_power("rest", "two")}
SELECT 1 AS component, round(value, 6) AS variance, true AS uncorrelated FROM one
UNION ALL SELECT 2, round(value, 6), true FROM two"""


def _docs(body: str) -> str:
    return _with(D) + body


# Confusion counts

SCORES = _with(D, *PARTS["bow_cosine"][0], f"""scores AS (
  SELECT 'bow_cosine' AS measure, p.is_clone, coalesce(round(r.s, 6), 0) AS s
  FROM p JOIN ({PARTS['bow_cosine'][1]}) r ON r.doc_id = p.doc_id)""")


def _counts(thresholds: tuple[float, ...], low: str) -> str:
    rows = ", ".join(f"({i}::BIGINT, {t}::DOUBLE)" for i, t in enumerate(thresholds))
    return _count_rows(f"scores, (VALUES {rows}) t(ord, threshold)", low)


def _count_rows(source: str, low: str) -> str:
    return f""", counts AS (
  SELECT measure, ord, threshold,
    CAST(count(*) FILTER (is_clone AND s >= threshold) AS BIGINT) AS tp,
    CAST(count(*) FILTER (NOT is_clone AND NOT s {low} threshold) AS BIGINT) AS fp,
    CAST(count(*) FILTER (is_clone AND s < threshold) AS BIGINT) AS fn,
    CAST(count(*) FILTER (NOT is_clone AND s {low} threshold) AS BIGINT) AS tn
  FROM {source} GROUP BY measure, ord, threshold)"""


def _rates(source: str) -> str:
    """`rates`: precision, recall and F of the counts in `source`."""
    return f""", pr AS (SELECT *, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall FROM {source}),
rates AS (SELECT *, {_div('2 * precision * recall', 'precision + recall')} AS f_measure FROM pr)"""


ACCURACY = f", acc AS (SELECT *, {_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy FROM counts)"
FIXED = _counts(evaluate.TREE_THRESHOLDS, "<")
METRIC_COLUMNS = "round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f_measure, 6) AS f_measure"
BEST = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY accuracy DESC, ord) AS rn FROM rates),
best AS (
  SELECT measure, CASE WHEN accuracy > 0 THEN threshold ELSE 0 END AS threshold, accuracy,
    CASE WHEN accuracy > 0 THEN precision ELSE 0 END AS precision,
    CASE WHEN accuracy > 0 THEN recall ELSE 0 END AS recall,
    CASE WHEN accuracy > 0 THEN f_measure ELSE 0 END AS f_measure FROM ranked WHERE rn = 1)"""


def _running(weight: int) -> str:
    upto = "OVER (PARTITION BY measure ORDER BY ord)"
    return f""", acc AS (
  SELECT measure, ord, threshold, {_div(f'tp + {weight} * tn', 'tp + fp + fn + tn')} AS accuracy,
    CAST(sum(tp) {upto} AS BIGINT) AS tp, CAST(sum(fp) {upto} AS BIGINT) AS fp, CAST(sum(fn) {upto} AS BIGINT) AS fn FROM counts)"""


def _inclusive(reset: bool) -> str:
    counts = _counts(evaluate.DEPENDENCE_THRESHOLDS, "<=")
    body = ACCURACY if reset else _running(1)
    return (
        SCORES + counts + body + _rates("acc")
        + f" SELECT measure, ord, threshold, tp, fp, fn, {METRIC_COLUMNS}, {str(reset).lower()} AS reset FROM rates"
    )


# Measures that are on the board by the documents' texts and vectors, and elsewhere by other tables.
BOARD_ONLY = {
    "markup_comment_similarity": (
        [_sets("comments", f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(text, '{MARKUP_COMMENT}'), ' '), '\\w+')) AS x FROM d")],
        f"SELECT doc_id, {_div('ni', 'na + nb - ni', 1.0)} AS s FROM comments_p",
    ),
    "call_similarity": (
        [_sets("calls", f"SELECT * FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{CALL_PATTERN}', 1)) AS x FROM d) WHERE x NOT IN ({KEYWORD_LIST})")],
        f"SELECT doc_id, {_div('ni', 'na + nb - ni')} AS s FROM calls_p",
    ),
    "cosine_similarity": (
        ["vecs AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"],
        """SELECT p.doc_id, CASE WHEN list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec) > 0
  THEN list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)) ELSE 0 END AS s
FROM p JOIN vecs a ON a.doc_id = p.o_id JOIN vecs b ON b.doc_id = p.doc_id""",
    ),
}


def _board() -> str:
    parts = PARTS | BOARD_ONLY
    ctes = [c for n in BOARD for c in parts[n][0]]
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS measure, p.is_clone, coalesce(round(r.s, 6), 0) AS s FROM p LEFT JOIN ({parts[n][1]}) r ON r.doc_id = p.doc_id" for n in BOARD
    )
    head = _with(D, *ctes, f"scores AS ({rows})")
    lists = ", ".join(f"('{n}', {i}::BIGINT, {t}::DOUBLE)" for n in BOARD for i, t in enumerate(board_thresholds(n)))
    counts = _count_rows(f"scores JOIN (VALUES {lists}) t(measure, ord, threshold) USING (measure)", "<")
    body = counts + ACCURACY + _rates("acc") + BEST
    return head + body + (
        f", final AS (SELECT measure, threshold, {METRIC_COLUMNS} FROM best) "
        "SELECT *, row_number() OVER (ORDER BY accuracy DESC, f_measure DESC, measure) AS place FROM final"
    )


# Vectors

VALUES = "unnest({v})::DOUBLE AS value, CAST(unnest(range(len({v}))) AS INTEGER) AS pos"
_values = lambda v: VALUES.format(v=v)
E = "e AS (SELECT vec_id AS doc_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
POOLED = """pooled AS (
  SELECT label, pos, avg(value) AS value FROM (
    SELECT label, unnest(vec) AS value, unnest(range(len(vec))) AS pos FROM e) GROUP BY label, pos)"""
STAR_VECTORS = _with(E, """first AS (SELECT source AS case_id, min(doc_id) AS o_id FROM documents GROUP BY source)""", """scored AS (
  SELECT d.source AS case_id, d.doc_id, d.lang = o.lang AS is_clone,
    CASE WHEN a.vec IS NULL OR b.vec IS NULL THEN NULL
      WHEN list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec) > 0
      THEN list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec))
      ELSE 0 END AS s
  FROM documents d JOIN first f ON d.source = f.case_id JOIN documents o ON o.doc_id = f.o_id
  LEFT JOIN e a ON a.doc_id = f.o_id LEFT JOIN e b ON b.doc_id = d.doc_id WHERE d.doc_id <> f.o_id)""")
LOOKUP = f"""bags AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest({_tokens('text')}) AS w FROM documents) GROUP BY doc_id, w),
slots AS (SELECT w, {_hash('w')} % (SELECT 2 * count(*) FROM e) AS slot FROM (SELECT DISTINCT w FROM bags)),
lookup AS (SELECT w, e.vec FROM slots JOIN e ON e.doc_id = slot),
means AS (
  SELECT doc_id, pos, sum(c * value) / sum(c) AS value FROM (
    SELECT b.doc_id, b.c, unnest(l.vec) AS value, unnest(range(len(l.vec))) AS pos FROM bags b JOIN lookup l ON l.w = b.w)
  GROUP BY doc_id, pos),
looked AS (
  SELECT d.doc_id, CAST(r.pos AS INTEGER) AS pos, coalesce(m.value, 0) AS value
  FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS pos) r LEFT JOIN means m ON m.doc_id = d.doc_id AND m.pos = r.pos)"""

CORPUS = _docs("""SELECT d.case_id,
  CASE WHEN d.doc_id = f.o_id THEN 'original' WHEN d.label = o.label THEN 'plagiarized' ELSE 'non-plagiarized' END AS role,
  d.label AS level, CAST(NULL AS VARCHAR) AS author, CAST(d.doc_id AS VARCHAR) AS stem, d.text
  FROM d JOIN first f ON d.case_id = f.case_id JOIN d o ON o.doc_id = f.o_id""")

UNIT_BANDS = " OR ".join(
    f"(x[{i + 1}] = y[{i + 1}] AND x[{i + 2}] = y[{i + 2}])" for i in range(0, len(MINHASH_SEEDS), MINHASH_BAND)
)
SEED_LIST = ", ".join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for a, b in MINHASH_SEEDS)

TFIDF = """n AS (SELECT count(*) AS n FROM d),
idf AS (SELECT w, ln((n + 1.0::DOUBLE) / (count(*) + 1)) AS idf FROM bags, n GROUP BY w, n),
wt AS (SELECT doc_id, w, c * idf AS x FROM bags JOIN idf USING (w)),
wn AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM wt GROUP BY doc_id),
dots AS (
  SELECT p.doc_id, sum(a.x * b.x) AS dot FROM p JOIN wt b ON b.doc_id = p.doc_id JOIN wt a ON a.doc_id = p.o_id AND a.w = b.w
  GROUP BY p.doc_id)"""
PARTS["tfidf_cosine"] = (
    [BAGS, TFIDF],
    f"""SELECT p.doc_id, {_div('coalesce(dot, 0)', 'coalesce(a.n * b.n, 0)')} AS s
FROM p LEFT JOIN dots ON dots.doc_id = p.doc_id LEFT JOIN wn a ON a.doc_id = p.o_id LEFT JOIN wn b ON b.doc_id = p.doc_id""",
)

NUMBERED = f"""edge AS (SELECT DISTINCT x.s AS src, x.t AS dst FROM edges),
deg AS MATERIALIZED (SELECT src, count(*) AS degree FROM edge GROUP BY src),
num AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {_hash('dst')} % {SHARDS}, dst) - 1 AS number FROM edge),
s0 AS (
  SELECT node || '#' || walk AS walk_id, node
  FROM (SELECT src AS node FROM edge UNION SELECT dst FROM edge), range({WALKS}) t(walk))"""


def _walk_tables() -> list[str]:
    """CTEs up to `walk` (node, slot, path): every walk draws each of its steps with its own generator, two states that `hash` starts."""
    (times_one, one), (times_other, other) = GENERATORS
    made = [f"""started AS (
  SELECT node, slot, {_hash(f"'{WALK_SEED}#' || node || '#' || slot")} AS h FROM (SELECT DISTINCT unnest(tk) AS node FROM d), range({WALKS}) t(slot))""",
        f"w0 AS (SELECT node, slot, node AS at, node AS path, 1 + h % {one - 1} AS s1, 1 + (h >> 30) % {other - 1} AS s2 FROM started)"]
    for t in range(1, WALK_LENGTH):
        made.append(f"""w{t} AS (
  SELECT l.node, l.slot, n.dst AS at, CASE WHEN n.dst IS NULL THEN path ELSE path || ' ' || n.dst END AS path, l.s1, l.s2
  FROM (SELECT * REPLACE (s1 * {times_one} % {one} AS s1, s2 * {times_other} % {other} AS s2) FROM w{t - 1}) l
  LEFT JOIN deg ON deg.src = l.at
  LEFT JOIN num n ON n.src = l.at AND n.number = ((l.s1 - l.s2 + {one - 1}) % {one - 1}) % deg.degree)""")
    return [*made, f"walk AS (SELECT * FROM w{WALK_LENGTH - 1})"]


def _word_vectors(sentences: str, window: int, dim: int = WORD_DIM, seed: int = 42) -> list[str]:
    """CTEs up to `wv` (w, x): random projections of the positive PMI rows of the token lists `tk` of `sentences`."""
    drawn = ", ".join(f"{_hash(f"'{seed}#{i}#' || v")} AS h{i}" for i in range(-(-dim // SIGN_BITS)))
    sums = ", ".join(f"sum(p * (2 * ((h{i // SIGN_BITS} >> {i % SIGN_BITS}) & 1) - 1))" for i in range(dim))
    return [
        f"""one_way AS (
  SELECT tk[i] AS u, tk[i + o] AS v FROM (SELECT tk, unnest(range(1, len(tk))) AS i FROM {sentences}), range(1, {window + 1}) t(o) WHERE i + o <= len(tk))""",
        "near AS (SELECT u, v, count(*) AS n FROM (SELECT u, v FROM one_way UNION ALL SELECT v, u FROM one_way) GROUP BY u, v)",
        "of_word AS (SELECT u, sum(n)::DOUBLE AS total FROM near GROUP BY u)",
        """pmi AS (
  SELECT near.u, near.v, ln(n * (SELECT sum(total) FROM of_word) / a.total / b.total) AS p
  FROM near JOIN of_word a ON a.u = near.u JOIN of_word b ON b.u = near.v)""",
        f"signs AS (SELECT v, {drawn} FROM (SELECT u AS v FROM of_word))",
        f"projected AS (SELECT u, [{sums}] AS x FROM pmi JOIN signs USING (v) WHERE p > 0 GROUP BY u)",
        f"""wv AS (
  SELECT w, coalesce(x, list_transform(range({dim}), lambda i: 0.0::DOUBLE)) AS x
  FROM (SELECT DISTINCT unnest(tk) AS w FROM {sentences}) LEFT JOIN projected ON u = w)""",
    ]


def _vector_facts(x: str) -> str:
    return f"{WORD_DIM} AS dim, round(sqrt(list_dot_product({x}, {x})), 4) AS length, round({x}[1], 4) + 0.0 AS first, round({x}[{WORD_DIM}], 4) + 0.0 AS last"


def _mean_vectors(sentences: str) -> str:
    """`dv` (doc_id, x): the mean vector of the words of each document, repeats included."""
    sums = ", ".join(f"avg(x[{i + 1}])" for i in range(WORD_DIM))
    return f"dv AS (SELECT doc_id, [{sums}] AS x FROM (SELECT doc_id, unnest(tk) AS w FROM {sentences}) JOIN wv USING (w) GROUP BY doc_id)"


ZEROS = f"list_transform(range({WORD_DIM}), lambda i: 0.0::DOUBLE)"
PAGE_EDGES = f"""sentences AS (
  SELECT doc_id, list(src || '->' || dst ORDER BY src || '->' || dst) AS tk FROM (
    SELECT DISTINCT doc_id, src, dst FROM (
      SELECT doc_id, dst, regexp_extract(param, '(\\w+)(?:\\s*\\[\\s*\\])*\\s*$', 1) AS src FROM (
        SELECT doc_id, dst, unnest(string_split(params, ',')) AS param FROM (
          SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '{HEADER}', 1)) AS dst,
            unnest(regexp_extract_all(html, '{HEADER}', 2)) AS params FROM pages)))
    WHERE src <> '' AND dst NOT IN ({KEYWORD_LIST})) GROUP BY doc_id)"""

ORACLE: dict[str, str] = {
    "corpus_scan": f"""SELECT case_id, role, level, author, stem, case_id || '/' || role || '/' || stem AS path, md5(text) AS code_md5 FROM ({CORPUS})""",
    "corpus_files": f"""SELECT case_id, role, stem AS author,
  md5(regexp_replace(coalesce(text, ''), chr(13) || chr(10) || '?', chr(10), 'g')) AS code_md5 FROM ({CORPUS})""",
    "original_select": f"SELECT case_id, stem, CAST(1 AS BIGINT) AS originals FROM ({CORPUS}) WHERE role = 'original'",
    "pair_generate": f"""WITH c AS ({CORPUS})
SELECT s.case_id, s.case_id || '/' || s.role || '/' || s.stem AS path, s.role = 'plagiarized' AS is_clone,
  CAST(length(o.text) AS BIGINT) AS a_chars, CAST(length(s.text) AS BIGINT) AS b_chars
FROM c s JOIN c o ON s.case_id = o.case_id AND o.role = 'original' WHERE s.role <> 'original'""",
    "vector_store_write": _with(E) + f"SELECT '{RUN_ID}' AS run_id, doc_id AS key, {_values('vec')} FROM e",
    "vector_store_read": _with(E) + f"""SELECT '{RUN_ID}' AS run_id, CAST(doc_id AS VARCHAR) AS key, true AS readable, {_values('vec')} FROM e
UNION ALL SELECT 'broken', 'broken' || doc_id, false, 0, -1 FROM e WHERE label = 0""",
    "embedding_backfill": _with(E, LOOKUP) + f"""SELECT doc_id, origin, pos, round(value, 6) AS value FROM (
  SELECT doc_id, 'stored' AS origin, {_values('vec')} FROM e WHERE doc_id IN (SELECT doc_id FROM documents))
UNION ALL SELECT doc_id, 'computed', pos, round(value, 6) FROM looked WHERE doc_id NOT IN (SELECT doc_id FROM e)""",
    "pretrained_vectors_load": _with(E) + f"SELECT 'w' || doc_id AS word, {_values('vec')} FROM e",
    "w2v_model_store": _docs("SELECT DISTINCT unnest(tk) AS tok, true AS same FROM d"),
    "w2v_train": _with(D, *_word_vectors("d", 5)) + f"SELECT w AS token, {_vector_facts('x')} FROM wv",
    "w2v_doc_vectors": _with(D, *_word_vectors("d", 5), _mean_vectors("d"), f"""unit AS (
  SELECT doc_id, CASE WHEN x IS NULL THEN {ZEROS} WHEN list_dot_product(x, x) > 0
    THEN list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) ELSE x END AS x FROM d LEFT JOIN dv USING (doc_id))""")
    + f"SELECT doc_id, {_vector_facts('x')} FROM unit",
    "pdg_w2v_similarity": _with(PAGES, PAGE_EDGES, *_word_vectors("sentences", 5), _mean_vectors("sentences")) + """
SELECT p.case_id, p.doc_id, round(CASE WHEN list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x) > 0
  THEN list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) ELSE 0 END, 6) AS similarity
FROM p LEFT JOIN dv a ON a.doc_id = p.o_id LEFT JOIN dv b ON b.doc_id = p.doc_id""",
    "random_walk_graph": _with(D, EDGES, NUMBERED, *_walk_tables())
    + """SELECT node || '#' || slot AS walk_id, CAST(len(string_split(path, ' ')) AS BIGINT) AS steps, path FROM walk""",
    "tokenize_ws": _docs("SELECT doc_id, unnest(tk) AS token, CAST(unnest(range(len(tk))) AS INTEGER) AS pos FROM d"),
    "vocab_count": _docs("SELECT token, count(*) AS n FROM (SELECT unnest(tk) AS token FROM d) GROUP BY token"),
    "token_nodes": _with(D, POSITIONS) + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, w AS token FROM pos",
    "token_edges": _with(D, EDGES) + "SELECT doc_id, x.s AS src, x.t AS dst FROM edges",
    "graph_stats": _with(D, NODES, EDGES) + """SELECT d.doc_id, coalesce(n.n, 0) AS nodes, coalesce(e.n, 0) AS edges
FROM d LEFT JOIN nodes_n n ON n.doc_id = d.doc_id LEFT JOIN edges_n e ON e.doc_id = d.doc_id""",
    "dummy_pad_nodes": _with(D, POSITIONS) + f"""SELECT p.case_id, p.doc_id, coalesce(t.n, 0) AS n,
  md5(coalesce(t.a_text, '')) AS a_md5, md5(coalesce(t.b_text, '')) AS b_md5
FROM p LEFT JOIN (
  SELECT g.doc_id, count(*) AS n, string_agg(coalesce(a.w, '{DUMMY_LABEL}' || g.pos), ' ' ORDER BY g.pos) AS a_text,
    string_agg(coalesce(b.w, '{DUMMY_LABEL}' || g.pos), ' ' ORDER BY g.pos) AS b_text
  FROM (SELECT doc_id, o_id, unnest(range(greatest(a_n, b_n))) AS pos FROM p) g
  LEFT JOIN pos a ON a.doc_id = g.o_id AND a.pos = g.pos LEFT JOIN pos b ON b.doc_id = g.doc_id AND b.pos = g.pos
  GROUP BY g.doc_id) t ON t.doc_id = p.doc_id""",
    "edge_tokens": _with(D, EDGES) + """SELECT doc_id, string_agg(t, ' ' ORDER BY t) AS edge_text
FROM (SELECT doc_id, x.s || '->' || x.t AS t FROM edges) GROUP BY doc_id""",
    "method_param_edges": f"""SELECT DISTINCT doc_id, src, dst, 'param' AS kind FROM (
  SELECT doc_id, dst, regexp_extract(param, '(\\w+)(?:\\s*\\[\\s*\\])*\\s*$', 1) AS src FROM (
    SELECT doc_id, dst, unnest(string_split(params, ',')) AS param FROM (
      SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '{HEADER}', 1)) AS dst,
        unnest(regexp_extract_all(html, '{HEADER}', 2)) AS params FROM pages)))
WHERE src <> '' AND dst NOT IN ({KEYWORD_LIST})""",
    "identifier_set": f"""SELECT doc_id, identifier, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY identifier) - 1 AS INTEGER) AS pos
FROM (SELECT DISTINCT page_id AS doc_id, unnest(regexp_extract_all(html, '{IDENTIFIER_PATTERN}')) AS identifier FROM pages)
WHERE identifier NOT IN ({KEYWORD_LIST})""",
    "flatten_lines": "SELECT doc_id, replace(text, chr(10), '') AS dropped, trim(replace(text, chr(10), ' ')) AS blanked FROM documents",
    "truncate_tokens": _docs(f"SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, array_to_string(tk[1:{MAX_TOKENS}], ' ') AS kept FROM d"),
    **{name: _measure(name) for name in PARTS},
    "comment_similarity": _page_sets(
        f"""SELECT DISTINCT doc_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(text, '{MARKUP_COMMENT}'), ' '), '\\w+')) AS x FROM d""",
        1.0,
    ),
    "call_similarity": _page_sets(
        f"SELECT * FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{CALL_PATTERN}', 1)) AS x FROM d) WHERE x NOT IN ({KEYWORD_LIST})",
        0.0,
    ),
    "minhash_candidates": _with(D, NODES, f"""sig AS (
  SELECT doc_id, list_transform([{SEED_LIST}], lambda s: list_min(list_transform(h, lambda v: (s.a * v + s.b) % {MINHASH_PRIME}))) AS x
  FROM (SELECT doc_id, list({_hash('x')} % {MINHASH_PRIME}) AS h FROM nodes GROUP BY doc_id))""",
        f"""joined AS (
  SELECT n.case_id, n.doc_id, {_div('ni', 'na + nb - ni')} AS s, a.x AS x, b.x AS y
  FROM nodes_p n LEFT JOIN sig a ON a.doc_id = n.o_id LEFT JOIN sig b ON b.doc_id = n.doc_id)""") + f"""SELECT case_id, doc_id, round(s, 6) AS similarity,
  round(coalesce(list_sum(list_transform(list_zip(x, y), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END))::DOUBLE / {len(MINHASH_SEEDS)}, 0), 6) AS estimate,
  coalesce({UNIT_BANDS}, false) AS candidate FROM joined""",
    "winnow_passages": _docs(f"""SELECT case_id, doc_id, CAST(min(a) AS INTEGER) AS a_start, CAST(min(b) AS INTEGER) AS b_start,
  CAST(max(b) - min(b) + {WINNOW_K} AS INTEGER) AS n_tokens, count(*) AS n_prints
FROM (SELECT *, sum(CASE WHEN b - before <= {WINNOW_WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, b - a ORDER BY b) AS passage
  FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id, b - a ORDER BY b) AS before FROM (
    WITH h AS (SELECT doc_id, case_id, list_transform({_grams('tk', WINNOW_K)}, lambda g: {_hash('g')}) AS h FROM d),
    w AS (SELECT doc_id, case_id, unnest(list_transform(range(1, greatest(len(h) - {WINNOW_WINDOW} + 1, 1) + 1), lambda i:
      {{'i': i, 'part': h[i:i + {WINNOW_WINDOW} - 1]}})) AS w FROM h WHERE len(h) > 0),
    f AS (SELECT DISTINCT doc_id, case_id, list_min(w.part) AS x, w.i + len(w.part) - 1 - list_position(list_reverse(w.part), list_min(w.part)) AS pos FROM w),
    o AS (SELECT f.case_id, x, min(pos) AS a FROM f JOIN (SELECT case_id, min(doc_id) AS doc_id FROM d GROUP BY case_id) USING (doc_id) GROUP BY f.case_id, x)
    SELECT f.case_id, f.doc_id, o.a, f.pos AS b FROM f JOIN o ON f.case_id = o.case_id AND f.x = o.x
    WHERE f.doc_id NOT IN (SELECT min(doc_id) FROM d GROUP BY case_id))))
GROUP BY case_id, doc_id, b - a, passage"""),
    # Exact: all pairs that share a shingle, and what a chain of similar pairs reaches.
    "minhash_classes": SIMILAR + CHAINS + "SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id FROM documents LEFT JOIN least_of USING (doc_id)",
    "kgram_join": SIMILAR + CHAINS + """SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(c, 0) AS n_links
FROM documents LEFT JOIN least_of USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS c FROM links GROUP BY a) USING (doc_id)""",
    "kgram_pairs": SIMILAR + """SELECT a, b, round(s, 6) AS similarity FROM links
WHERE a > b AND s < 1 AND NOT EXISTS (FROM links e WHERE e.s = 1 AND (e.a = links.a AND e.b < e.a OR e.a = links.b AND e.b < e.a))""",
    **{f"{name}_facts": LEARNED_FACTS for name in ("node2vec_similarity", "glove_factorize", "spectral_embed")},
    "cosine_similarity": STAR_VECTORS + "SELECT case_id, doc_id, is_clone, round(s, 6) AS similarity FROM scored",
    "failed_pair_zero": STAR_VECTORS + """SELECT case_id, doc_id, is_clone, round(coalesce(s, 0), 6) AS similarity, 'zero' AS policy FROM scored
UNION ALL SELECT case_id, doc_id, is_clone, round(s, 6), 'drop' FROM scored WHERE s IS NOT NULL""",
    "anchor_cosine": _with(E, "o AS (SELECT * FROM e WHERE doc_id IN (SELECT min(doc_id) FROM e GROUP BY label))") + """SELECT o.doc_id AS anchor_id, e.doc_id,
  o.label = e.label AS is_clone, round(list_dot_product(o.vec, e.vec) / sqrt(list_dot_product(o.vec, o.vec) * list_dot_product(e.vec, e.vec)), 6) AS similarity
FROM o, e WHERE e.doc_id NOT IN (SELECT doc_id FROM o)""",
    "mean_pool": _with(E, POOLED) + "SELECT label, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM pooled",
    "first_pool": _with(E) + f"SELECT label, {_values('vec')} FROM e WHERE doc_id IN (SELECT min(doc_id) FROM e GROUP BY label)",
    "l2_normalize": _with(E, POOLED) + """SELECT label, CAST(pos AS INTEGER) AS pos,
  round(CASE WHEN n > 0 THEN value / n ELSE value END, 6) AS value
FROM pooled JOIN (SELECT label, sqrt(sum(value * value)) AS n FROM pooled GROUP BY label) USING (label)""",
    "pad_truncate_vec": _with(E) + f"""SELECT doc_id, CAST(dim AS INTEGER) AS dim, {_values('v')} FROM (
  SELECT doc_id, dim, list_transform(range(1, dim + 1), lambda i: coalesce(vec[i], 0)) AS v FROM e, (VALUES (16), (100)) t(dim))""",
    "lookup_doc_vectors": _with(E, LOOKUP) + "SELECT doc_id, pos, round(value, 6) AS value FROM looked",
    "pca_variance": PCA,
    "threshold_sweep": SCORES + FIXED + " SELECT * FROM counts",
    "eval_metrics": SCORES + FIXED + ACCURACY + _rates("acc") + f" SELECT measure, ord, threshold, tp, fp, fn, tn, {METRIC_COLUMNS} FROM rates",
    "best_threshold": SCORES + FIXED + ACCURACY + _rates("acc") + BEST + f" SELECT measure, threshold, {METRIC_COLUMNS} FROM best",
    "legacy_sweep": SCORES + _counts(evaluate.TREE_THRESHOLDS, "<=") + _running(2) + _rates("acc")
    + f" SELECT measure, ord, threshold, tp, fp, fn, {METRIC_COLUMNS} FROM rates",
    "legacy_report": SCORES + _counts(evaluate.TREE_THRESHOLDS, "<=") + _running(2) + _rates("acc") + BEST + """
SELECT best.measure, best.threshold, round(best.accuracy, 6) AS accuracy, round(l.precision, 6) AS precision, round(l.recall, 6) AS recall,
  round(l.f_measure, 6) AS f_measure
FROM best JOIN (SELECT * FROM rates QUALIFY row_number() OVER (PARTITION BY measure ORDER BY ord DESC) = 1) l USING (measure)""",
    "inclusive_sweep": f"SELECT * FROM ({_inclusive(False)}) UNION ALL SELECT * FROM ({_inclusive(True)})",
    "confusion_matrix": SCORES + FIXED + """ SELECT measure, threshold, 0::BIGINT AS row, 0::BIGINT AS col, tp AS n FROM counts
UNION ALL SELECT measure, threshold, 0, 1, fp FROM counts UNION ALL SELECT measure, threshold, 1, 0, fn FROM counts
UNION ALL SELECT measure, threshold, 1, 1, tn FROM counts""",
    "approach_leaderboard": _board(),
}
