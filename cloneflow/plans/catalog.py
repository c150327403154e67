"""One named query per operator, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneflow.functions import text as tx
from cloneflow.functions.vector import l2_normalize, norm, pad_truncate
from cloneflow.operators import candidates, embed, evaluate, graph, kgrams, measures
from cloneflow.session import fresh_path, materialize
from cloneflow.sources import corpus, tables, vectors

Query = Callable[[SparkSession, str], DataFrame]

DIM = 64
LEARNED_DIM = 16
WORD_DIM = 100
RUN_ID = "20240101_000000"
DIGITS = 6
WALK_LENGTH = 30
WALKS = 3
# Walks per node that node vectors are learned from: all of the above. The reference makes 200, which is not reached (README).
VECTOR_WALKS = WALKS
WALK_SEED = 42

BOARD = [
    "graph_node_jaccard",
    "token_overlap",
    "bag_quick_ratio",
    "graph_edit_similarity",
    "bow_cosine",
    "rolling_hash",
    "jaccard",
    "metric_profile",
    "ngram_similarity",
    "rk_match",
    "winnow",
    "longest_block",
    "levenshtein",
    "fuzzy_token_sort",
    "markup_comment_similarity",
    "call_similarity",
    "tfidf_cosine",
    "cosine_similarity",
]
# Graphs of tokens and of dependences have threshold lists of their own; all other measures take the tree list.
FAMILIES = {"graph_node_jaccard": evaluate.GRAPH_THRESHOLDS, "graph_edit_similarity": evaluate.DEPENDENCE_THRESHOLDS}

CATALOG: dict[str, Query] = {}


def query(function: Query) -> Query:
    CATALOG[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


def values(df: DataFrame, *keys: str, vec: str = "vec") -> DataFrame:
    """One row per vector entry."""
    return df.select(*keys, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "value"))


# Sources and sinks


@query
def corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.label_table(tables.documents(spark, sf))
    return files.select("case_id", "role", "level", "author", "stem", "path", F.md5(F.col("code").cast("binary")).alias("code_md5"))


@query
def corpus_files(spark: SparkSession, sf: str) -> DataFrame:
    root = fresh_path(spark, "corpus")
    corpus.write_corpus(corpus.label_table(tables.documents(spark, sf)).withColumn("author", F.col("stem")), root)
    files = corpus.read_corpus(spark, root, ".txt")
    return files.select("case_id", "role", "author", F.md5(F.col("code").cast("binary")).alias("code_md5"))


@query
def original_select(spark: SparkSession, sf: str) -> DataFrame:
    good, rejected = corpus.pick_originals(corpus.label_table(tables.documents(spark, sf)))
    good = good.select("case_id", "stem", F.lit(1).cast("bigint").alias("originals"))
    return good.unionByName(rejected.select("case_id", F.lit(None).cast("string").alias("stem"), "originals"))


@query
def pair_generate(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.label_table(tables.documents(spark, sf))
    pairs = corpus.make_pairs(files, {"chars": lambda text, toks: F.char_length(text)})
    return pairs.select("case_id", "path", "is_clone", F.col("a_chars").cast("bigint"), F.col("b_chars").cast("bigint"))


@query
def vector_store_write(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "vector_store")
    stored = tables.embeddings(spark, sf).select(F.col("doc_id").alias("key"), F.col("vec").alias("embedding"))
    vectors.write_vectors(stored, path, RUN_ID)
    back = vectors.read_vectors(spark, path)
    return values(back.withColumn("run_id", F.col("run_id").cast("string")), "run_id", "key", vec="embedding")


@query
def vector_store_read(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "vector_json")
    rows = tables.embeddings(spark, sf).select(F.col("doc_id").alias("key"), F.col("vec").cast("array<double>").alias("embedding"), "label")
    vectors.write_vectors(rows.select("key", "embedding"), path, RUN_ID, as_json=True)
    # The vectors of label 0 are stored a second time as broken JSON, the way an interrupted writer leaves them.
    broken = rows.where(F.col("label") == 0).select(
        F.concat(F.lit("broken"), F.col("key").cast("string"), F.lit("\t"), F.regexp_replace(F.to_json("embedding"), r"\]$", ",")).alias("value")
    )
    broken.write.text(f"{path}/run_id=broken")
    back = vectors.read_vectors(spark, path, as_json=True)
    # An unreadable vector is one row at position -1.
    entries = back.select("run_id", "key", F.col("embedding").isNotNull().alias("readable"), F.posexplode_outer("embedding").alias("pos", "value"))
    return entries.withColumns({"pos": F.coalesce("pos", F.lit(-1)), "value": F.coalesce("value", F.lit(0.0))})


@query
def embedding_backfill(spark: SparkSession, sf: str) -> DataFrame:
    docs, stored = tables.documents(spark, sf), tables.embeddings(spark, sf)
    lookup = tables.word_lookup(docs, stored)

    def compute(missing: DataFrame) -> DataFrame:
        made = embed.lookup_doc_vectors(measures.term_counts(missing), lookup, missing, DIM)
        return made.withColumnRenamed("vec", "embedding")

    done = vectors.backfill(docs, stored.withColumnRenamed("vec", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>")), "doc_id", compute)
    return rounded(values(done, "doc_id", "origin", vec="embedding"), "value")


@query
def pretrained_vectors_load(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "word_vectors")
    stored = tables.embeddings(spark, sf)
    lines = stored.select(F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit(" "), F.array_join(F.col("vec").cast("array<string>"), " ")).alias("value"))
    header = stored.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.max(F.size("vec")).cast("string")).alias("value"))
    header.unionByName(lines).write.text(path)
    return values(vectors.read_word_vectors(spark, path), "word")


@query
def w2v_model_store(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    trained = materialize(embed.w2v_train(docs.select(tx.tokens(F.col("text")).alias("tokens")), WORD_DIM), "w2v")
    path = fresh_path(spark, "w2v_model")
    vectors.write_vectors(trained.select(F.col("tok").alias("key"), F.col("vec").alias("embedding")), path, RUN_ID)
    loaded = vectors.read_vectors(spark, path).select(F.col("key").alias("tok"), F.col("embedding").alias("loaded"))
    return trained.join(loaded, "tok", "full").select("tok", F.coalesce(F.col("vec") == F.col("loaded"), F.lit(False)).alias("same"))


# Tokens and token graphs


@query
def tokenize_ws(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf).select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "token"))


@query
def vocab_count(spark: SparkSession, sf: str) -> DataFrame:
    return measures.vocabulary(tables.documents(spark, sf)).select(F.col("tok").alias("token"), "n")


@query
def token_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_nodes(tables.documents(spark, sf))


@query
def token_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_edges(tables.documents(spark, sf))


@query
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_stats(tables.documents(spark, sf))


@query
def dummy_pad_nodes(spark: SparkSession, sf: str) -> DataFrame:
    pairs = graph.padded_pairs(tables.documents(spark, sf))
    name = lambda nodes: F.md5(F.array_join(nodes, " ").cast("binary"))
    return pairs.select("case_id", "doc_id", F.size("a_nodes").cast("bigint").alias("n"), name("a_nodes").alias("a_md5"), name("b_nodes").alias("b_md5"))


@query
def edge_tokens(spark: SparkSession, sf: str) -> DataFrame:
    made = graph.text_edge_tokens(tables.documents(spark, sf))
    return made.select("doc_id", F.array_join("tokens", " ").alias("edge_text"))


@query
def method_param_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.method_param_edges(tables.pages(spark, sf), with_body=False)


@query
def identifier_set(spark: SparkSession, sf: str) -> DataFrame:
    return tables.pages(spark, sf).select("doc_id", F.posexplode(tx.identifiers(F.col("text"))).alias("pos", "identifier"))


@query
def flatten_lines(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return tables.documents(spark, sf).select(
        "doc_id", tx.flatten_lines(text).alias("dropped"), tx.flatten_lines(text, with_blank=True).alias("blanked")
    )


@query
def truncate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    cut = tables.documents(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    kept = tx.truncate(F.col("t"))
    return cut.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join(kept, " ").alias("kept"))


# Pair measures


def _measure_query(name: str, key: str, source: Callable[[SparkSession, str], DataFrame]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        scores = measures.score_table(source(spark, sf), [name], label=None)
        return scores.select("case_id", "doc_id", F.round(name, DIGITS).alias("similarity"))

    run.__name__ = key
    CATALOG[key] = run


for _name in measures.MEASURES:
    if _name in ("comment_similarity", "markup_comment_similarity", "call_similarity"):
        continue
    _measure_query(_name, _name, tables.documents)
_measure_query("markup_comment_similarity", "comment_similarity", tables.pages)
_measure_query("call_similarity", "call_similarity", tables.pages)


@query
def tfidf_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(measures.tfidf_cosine(tables.documents(spark, sf)), "similarity")


@query
def winnow_passages(spark: SparkSession, sf: str) -> DataFrame:
    return measures.winnow_passages(tables.documents(spark, sf))


@query
def minhash_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(measures.minhash_candidates(tables.documents(spark, sf)), "similarity", "estimate")


@query
def minhash_classes(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.minhash_classes(tables.documents(spark, sf)).select("doc_id", "class_id")


@query
def kgram_pairs(spark: SparkSession, sf: str) -> DataFrame:
    _, links = kgrams.similar_texts(tables.documents(spark, sf))
    return rounded(links, "similarity")


@query
def kgram_join(spark: SparkSession, sf: str) -> DataFrame:
    return kgrams.kgram_join(tables.documents(spark, sf))


# Vectors


@query
def cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    scores = embed.star_cosine(tables.documents(spark, sf), tables.embeddings(spark, sf))
    return rounded(scores, "similarity")


@query
def anchor_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(embed.anchor_cosine(tables.embeddings(spark, sf)), "similarity")


@query
def failed_pair_zero(spark: SparkSession, sf: str) -> DataFrame:
    scores = embed.star_cosine(tables.documents(spark, sf), tables.embeddings(spark, sf))
    policies = [evaluate.score_failed(scores, p).withColumn("policy", F.lit(p)) for p in ("zero", "drop")]
    return rounded(policies[0].unionByName(policies[1]), "similarity")


@query
def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(values(embed.mean_pool(tables.embeddings(spark, sf), ["label"], DIM), "label"), "value")


@query
def first_pool(spark: SparkSession, sf: str) -> DataFrame:
    return values(embed.first_pool(tables.embeddings(spark, sf), "label", "doc_id"), "label")


@query
def l2_normalize_vectors(spark: SparkSession, sf: str) -> DataFrame:
    pooled = embed.mean_pool(tables.embeddings(spark, sf), ["label"], DIM)
    return rounded(values(pooled.withColumn("vec", l2_normalize(F.col("vec"))), "label"), "value")


CATALOG["l2_normalize"] = CATALOG.pop("l2_normalize_vectors")


@query
def pad_truncate_vec(spark: SparkSession, sf: str) -> DataFrame:
    stored = tables.embeddings(spark, sf)
    forms = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), pad_truncate(F.col("vec"), d).alias("vec")) for d in (16, 100)]))
    return values(stored.select("doc_id", forms.alias("f")).select("doc_id", "f.dim", "f.vec"), "doc_id", "dim")


@query
def lookup_doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs, stored = tables.documents(spark, sf), tables.embeddings(spark, sf)
    made = embed.lookup_doc_vectors(measures.term_counts(docs), tables.word_lookup(docs, stored), docs, DIM)
    return rounded(values(made, "doc_id"), "value")


def _facts(vec: str) -> list:
    """A vector's size, its length and its first and last entries."""
    entry = lambda i: F.round(F.element_at(vec, i), 4)
    return [F.size(vec).alias("dim"), F.round(norm(F.col(vec)), 4).alias("length"), entry(1).alias("first"), entry(-1).alias("last")]


@query
def w2v_train(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    trained = embed.w2v_train(docs.select(tx.tokens(F.col("text")).alias("tokens")), WORD_DIM)
    return trained.select(F.col("tok").alias("token"), *_facts("vec"))


@query
def w2v_doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    trained = embed.w2v_train(docs.select(tx.tokens(F.col("text")).alias("tokens")), WORD_DIM)
    made = embed.w2v_doc_vectors(measures.term_counts(docs), materialize(trained, "w2v"), docs, WORD_DIM)
    return made.select("doc_id", *_facts("vec"))


@query
def pdg_w2v_similarity(spark: SparkSession, sf: str) -> DataFrame:
    table = tables.pages(spark, sf)
    sentences = materialize(graph.edge_tokens(graph.method_param_edges(table, with_body=False)), "edge_tokens")
    trained = embed.w2v_train(sentences.select("tokens"), WORD_DIM)
    terms = sentences.select("doc_id", F.inline(tx.bag(F.col("tokens"))))
    made = embed.w2v_doc_vectors(terms, materialize(trained, "w2v"), table, WORD_DIM, unit=False)
    return rounded(embed.star_cosine(table, materialize(made, "page_vectors")).select("case_id", "doc_id", "similarity"), "similarity")


def _walks(docs: DataFrame, walks: int = WALKS) -> DataFrame:
    """Walks from every token, those of documents of one token included."""
    # Any other token has an edge.
    alone = docs.select(tx.tokens(F.col("text")).alias("t")).where(F.size("t") == 1).select(F.get("t", F.lit(0)).alias("node"))
    return graph.random_walks(graph.graph_edges(docs), WALK_LENGTH, walks, WALK_SEED, nodes=alone)


@query
def random_walk_graph(spark: SparkSession, sf: str) -> DataFrame:
    walks = _walks(tables.documents(spark, sf))
    return walks.select("walk_id", F.size("tokens").cast("bigint").alias("steps"), F.array_join("tokens", " ").alias("path"))


def _graph_query(docs: DataFrame, lookup: DataFrame) -> DataFrame:
    nodes = graph.graph_nodes(docs).select("doc_id", F.col("token").alias("tok"))
    lookup = materialize(embed.with_lonely_nodes(lookup, nodes, LEARNED_DIM), "node_vectors")
    scores = embed.graph_similarity(docs, lookup, nodes, LEARNED_DIM)
    return scores.select("case_id", "doc_id", "similarity")


@query
def node2vec_similarity(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    walks = materialize(_walks(docs, VECTOR_WALKS), "walks")
    return _graph_query(docs, embed.word_factors(walks, LEARNED_DIM, window=10))


@query
def glove_factorize(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    return _graph_query(docs, embed.glove_factorize(graph.corpus_edges(docs), LEARNED_DIM))


@query
def spectral_embed(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    return _graph_query(docs, embed.spectral_embed(graph.corpus_edges(docs), LEARNED_DIM))


def _fact_query(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """What must hold for each star pair, whatever the fit: equal token sets score 1, a text without tokens scores 0, all scores lie between -1 and 1."""
        scores = CATALOG[name](spark, sf)
        sets = tables.documents(spark, sf).select("case_id", "doc_id", "text", F.lit(None).cast("string").alias("label"))
        made = {
            "set": lambda text, toks: F.md5(F.array_join(F.array_sort(F.array_distinct(toks)), " ").cast("binary")),
            "some": lambda text, toks: F.size(toks) > 0,
        }
        pairs = corpus.star_pairs(sets, made, label=None)
        kind = F.when(~F.col("a_some") | ~F.col("b_some"), "empty").when(F.col("a_set") == F.col("b_set"), "copy").otherwise("other")
        joined = pairs.select("case_id", "doc_id", kind.alias("kind")).join(scores, ["case_id", "doc_id"], "left")
        score = F.col("similarity")
        fine = F.when(F.col("kind") == "empty", score == 0).when(F.col("kind") == "copy", F.abs(score - 1) < 1e-6).otherwise(F.abs(score) <= 1 + 1e-9)
        return joined.select("case_id", "doc_id", "kind", F.coalesce(fine, F.lit(False)).alias("holds"))

    CATALOG[f"{name}_facts"] = run


for _name in ("node2vec_similarity", "glove_factorize", "spectral_embed"):
    _fact_query(_name)


# Evaluation


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    wide = measures.score_table(tables.documents(spark, sf), ["bow_cosine"])
    return measures.long_scores(wide, ["bow_cosine"], DIGITS)


@query
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.sweep(_scores(spark, sf), evaluate.TREE_THRESHOLDS)


@query
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    metrics = evaluate.eval_metrics(evaluate.sweep(_scores(spark, sf), evaluate.TREE_THRESHOLDS))
    return rounded(metrics, "accuracy", "precision", "recall", "f_measure")


@query
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    metrics = evaluate.eval_metrics(evaluate.sweep(_scores(spark, sf), evaluate.TREE_THRESHOLDS))
    return rounded(evaluate.best_threshold(metrics), "accuracy", "precision", "recall", "f_measure")


@query
def legacy_sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.legacy_sweep(_scores(spark, sf), evaluate.TREE_THRESHOLDS)
    return rounded(rows, "accuracy", "precision", "recall", "f_measure")


@query
def legacy_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.legacy_sweep(_scores(spark, sf), evaluate.TREE_THRESHOLDS)
    return rounded(evaluate.legacy_report(rows), "accuracy", "precision", "recall", "f_measure")


@query
def inclusive_sweep(spark: SparkSession, sf: str) -> DataFrame:
    scores = _scores(spark, sf)
    modes = [evaluate.inclusive_sweep(scores, evaluate.DEPENDENCE_THRESHOLDS, r).withColumn("reset", F.lit(r)) for r in (False, True)]
    return rounded(modes[0].unionByName(modes[1]), "accuracy", "precision", "recall", "f_measure")


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion_matrix(evaluate.sweep(_scores(spark, sf), evaluate.TREE_THRESHOLDS))


@query
def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    placed = embed.pca_projection(tables.embeddings(spark, sf))
    return placed.select("doc_id", "label", F.get("pc", F.lit(0)).alias("x"), F.get("pc", F.lit(1)).alias("y"))


@query
def pca_variance(spark: SparkSession, sf: str) -> DataFrame:
    """What makes the projection one of principal components: the variance along each, and that they are uncorrelated."""
    placed = embed.pca_projection(tables.embeddings(spark, sf)).select(F.get("pc", F.lit(0)).alias("x"), F.get("pc", F.lit(1)).alias("y"))
    facts = placed.agg(F.var_samp("x").alias("x"), F.var_samp("y").alias("y"), (F.abs(F.corr("x", "y")) < 1e-6).alias("uncorrelated"))
    rows = [F.struct(F.lit(i + 1).alias("component"), F.round(c, DIGITS).alias("variance"), "uncorrelated") for i, c in enumerate(("x", "y"))]
    return facts.select(F.inline(F.array(*rows)))


def board_thresholds(name: str) -> tuple[float, ...]:
    return FAMILIES.get(name, evaluate.TREE_THRESHOLDS)


def board_scores(docs: DataFrame, names: list[str], others: dict[str, DataFrame]) -> DataFrame:
    """`case_id, doc_id, is_clone, measure, similarity`: row-local measures in one pass, and `others`, each `case_id, doc_id, similarity`, joined to it. A pair
    that one of the others lacks has a null score, which a sweep counts as 0."""
    wide = measures.score_table(docs, names)
    for name, scores in others.items():
        wide = wide.join(scores.select("case_id", "doc_id", F.col("similarity").alias(name)), ["case_id", "doc_id"], "left")
    return materialize(measures.long_scores(wide, [*names, *others], DIGITS), "board_scores")


def board(scores: DataFrame, names: list[str]) -> DataFrame:
    """The measures ranked by their best thresholds, each judged by its family's list."""
    lists = sorted({board_thresholds(n) for n in names})
    counts = [evaluate.sweep(scores.where(F.col("measure").isin([n for n in names if board_thresholds(n) == t])), t) for t in lists]
    metrics = evaluate.eval_metrics(reduce(DataFrame.unionByName, counts))
    return evaluate.leaderboard(rounded(evaluate.best_threshold(metrics), "accuracy", "precision", "recall", "f_measure"))


@query
def approach_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    others = {"tfidf_cosine": measures.tfidf_cosine(docs), "cosine_similarity": embed.star_cosine(docs, tables.embeddings(spark, sf))}
    return board(board_scores(docs, [n for n in BOARD if n in measures.MEASURES], others), BOARD)
