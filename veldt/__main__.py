"""Jobs over paths: python -m veldt JOB --option value.  Every job reads tables, runs operators and writes a table."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import configs, deltas, dense, metrics, retrieval, scoring, trees, vector_index
from .operators import semantic_ids as S
from .sources import io

JOBS: dict = {}


def job(name: str, *options: str, **defaults):
    """Register a job: options must be given, defaults may be."""

    def keep(f):
        JOBS[name] = (f, options, defaults)
        return f

    return keep


def _vectors(df: DataFrame, column: str) -> DataFrame:
    """The column as array<double>, from an array or from text joined by commas."""
    text = dict(df.dtypes)[column] == "string"
    return df.withColumn(column, retrieval.parse_vector(F.col(column))) if text else df


@job("eval", "input", "output", prediction="probs", label="label", group="", step=0)
def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """AUC, accuracy, errors and entropy of a table of predictions, as one JSON line."""
    df = io.read(spark, a.input)
    wanted = {"auc": (metrics.auc, a.prediction, a.label), "accuracy": (metrics.accuracy, a.prediction, a.label), "normalized_entropy": (metrics.normalized_entropy, a.prediction, a.label)}
    if a.group:
        wanted["grouped_auc"] = (metrics.grouped_auc, a.group, a.prediction, a.label)
    line = scoring.report_line(metrics.evaluate(df, wanted), int(a.step))
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(a.output)


@job("predict", "input", "weights", "output", reserved="", bias=0.0)
def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    """Probabilities of a logistic model whose weights are JSON, beside reserved columns."""
    from pyspark.sql import types as T

    weights = {k: float(v) for k, v in json.loads(a.weights).items()}
    kept = [c for c in a.reserved.split(",") if c]
    out = scoring.predict(io.read(spark, a.input), scoring.linear_model(weights, float(a.bias)), list(weights), {"logits": T.DoubleType(), "probs": T.DoubleType()}, kept)
    io.write_predictions(out, a.output, ["logits", "probs"], kept)


@job("predict-model", "input", "weights", "model", "outputs", "output", reserved="")
def predict_model(spark: SparkSession, a: argparse.Namespace) -> None:
    """Outputs of a dense model, a JSON list of steps with a table of weights (name, i, v), beside reserved columns."""
    kept, outputs = ([c for c in x.split(",") if c] for x in (a.reserved, a.outputs))
    out = dense.score(io.read(spark, a.input), json.loads(a.model), dense.load_weights(io.read(spark, a.weights)), outputs, kept)
    io.write_predictions(out, a.output, outputs, kept)


@job("hitrate", "queries", "items", "output", query_id="request_id", item_id="item_id", truth="gt_items", query_vector="user_tower_emb", item_vector="item_tower_emb", k=200, metric="ip")
def hitrate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Details of each query, and the rate of all, in two tables of the output."""
    q, i = _vectors(io.read(spark, a.queries), a.query_vector), _vectors(io.read(spark, a.items), a.item_vector)
    if dict(q.dtypes)[a.truth] == "string":
        q = q.withColumn(a.truth, F.split(a.truth, ","))
    ids = i.select(F.col(a.item_id).alias("item_id"), F.col(a.item_vector).alias("embedding"))
    found = retrieval.top_k(q.select(F.col(a.query_id).alias("query_id"), F.col(a.query_vector).alias("embedding")), ids, int(a.k), metric=a.metric)
    details = retrieval.hit_details(found, q.select(F.col(a.query_id).alias("query_id"), F.col(a.truth).alias("gt_items")))
    io.write(details, f"{a.output}/details", inputs=[a.queries, a.items])
    io.write(retrieval.hit_rate(io.read(spark, f"{a.output}/details")), f"{a.output}/total")


@job("build-index", "input", "output", item_id="item_id", vector="embedding", metric="ip", cells=0, links=vector_index.LINKS, rounds=8, generation="1")
def build_index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Fit cells on all vectors and store the index; without links there is no graph, without cells their number follows the table."""
    io.reject_overlap(a.output, [a.input])
    items = _vectors(io.read(spark, a.input, [a.item_id, a.vector]), a.vector)
    cells = int(a.cells) or vector_index.cell_count(items.count())
    centres = vector_index.fit_cells(items, cells, a.item_id, a.vector, int(a.rounds))
    vector_index.build_index(items, centres, a.metric, a.item_id, a.vector, int(a.links)).save(a.output, a.generation)


@job("search-index", "queries", "index", "output", query_id="query_id", vector="embedding", k=100, probes=16, beam=0, generation="1")
def search_index(spark: SparkSession, a: argparse.Namespace) -> None:
    """The nearest items of each query in a stored index; a beam walks its graphs."""
    index = vector_index.VectorIndex.load(spark, a.index, a.generation)
    queries = _vectors(io.read(spark, a.queries, [a.query_id, a.vector]), a.vector)
    io.write(vector_index.search(index, queries, int(a.k), int(a.probes), int(a.beam) or None, a.query_id, a.vector), a.output, inputs=[a.queries, a.index])


@job("sid-quality", "input", "sizes", "output", codes="codes", after="")
def sid_quality(spark: SparkSession, a: argparse.Namespace) -> None:
    """The quality report of semantic ids, perhaps against those after a change."""
    io.write(S.quality_report(io.read(spark, a.input), a.codes, [int(x) for x in a.sizes.split(",")], a.after or None), a.output, inputs=[a.input])


@job("resolve-collisions", "input", "sizes", "output", codes="codes", item_id="item_id", capacity=1, draws=8, published="")
def resolve(spark: SparkSession, a: argparse.Namespace) -> None:
    """Items beyond a bucket's capacity get other last codes; with `published`, new items only."""
    items, sizes = S.with_hash(io.read(spark, a.input), a.item_id), [int(x) for x in a.sizes.split(",")]
    if a.published:
        for name, df in S.append_items(io.read(spark, a.published), items, a.codes, sizes, int(a.capacity), draws=int(a.draws)).items():
            io.write(df, f"{a.output}/{name}", inputs=[a.input, a.published])
    else:
        io.write(S.resolve_collisions(items, a.codes, sizes, int(a.capacity), draws=int(a.draws)), a.output, inputs=[a.input])


@job("init-tree", "input", "output", item_id="item_id", category="category", branches=2, attributes="", raw_attributes="", vector="")
def init_tree(spark: SparkSession, a: argparse.Namespace) -> None:
    """Leaves, by category or, where a vector is named, by clusters; nodes, edges, predict edges and the serving tree."""
    df, b = io.read(spark, a.input), int(a.branches)
    attributes, raw = ([c for c in x.split(",") if c] for x in (a.attributes, a.raw_attributes))
    leaves = trees.cluster_tree(_vectors(df, a.vector), a.item_id, a.vector, b) if a.vector else trees.category_tree(df, a.item_id, a.category, b)
    io.write(leaves.join(df.select(F.col(a.item_id).alias("item_id"), *attributes, *raw), "item_id"), f"{a.output}/leaves", inputs=[a.input])
    io.write(trees.build_tree(io.read(spark, f"{a.output}/leaves"), b, attributes, raw), f"{a.output}/nodes")
    nodes = io.read(spark, f"{a.output}/nodes")
    for name, out in (("edges", trees.tree_edges(nodes, b)), ("predict_edges", trees.predict_edges(nodes, b)), ("serving", trees.serving_tree(nodes)), ("node_table", trees.node_table(nodes, [*attributes, *raw]))):
        io.write(out, f"{a.output}/{name}")


@job("tree-retrieval", "queries", "nodes", "weights", "model", "output", query_id="query_id", branches=2, k=100, truth="")
def tree_retrieval(spark: SparkSession, a: argparse.Namespace) -> None:
    """The best leaves of each query by a dense model that scores nodes level by level; with a table of true items, their recall."""
    steps, weights = json.loads(a.model), dense.load_weights(io.read(spark, a.weights))
    queries, nodes = io.read(spark, a.queries), io.read(spark, a.nodes)
    found = trees.beam_search(queries, nodes, int(a.k), int(a.branches), lambda t: dense.score(t, steps, weights, ["score"], t.columns), a.query_id)
    io.write(found.select(a.query_id, "item_id", "score", "rank"), f"{a.output}/found", inputs=[a.queries, a.nodes])
    if a.truth:
        io.write(trees.retrieval_recall(io.read(spark, f"{a.output}/found"), io.read(spark, a.truth), a.query_id), f"{a.output}/recall", inputs=[a.truth])


@job("compare-deltas", "local", "remote", "output", keys="feature_name,key_id", quantised=0)
def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """How many local embedding rows match those of a remote store, differ or are missing there."""
    found = deltas.reconcile(io.read(spark, a.local), io.read(spark, a.remote), a.keys.split(","), quantised=bool(int(a.quantised)))
    io.write(deltas.reconcile_summary(found), a.output, inputs=[a.local, a.remote])


@job("select-features", "input", "output", top=20)
def select(spark: SparkSession, a: argparse.Namespace) -> None:
    """The features of each group that dropout spares most."""
    io.write(configs.select_features(io.read(spark, a.input), int(a.top)), a.output, inputs=[a.input])


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="veldt")
    commands = parser.add_subparsers(dest="job", required=True)
    for name, (f, options, defaults) in JOBS.items():
        command = commands.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        for option in options:
            command.add_argument(f"--{option.replace('_', '-')}", required=True)
        for option, value in defaults.items():
            command.add_argument(f"--{option.replace('_', '-')}", default=value)
    a = parser.parse_args(arguments)
    JOBS[a.job][0](spark or SparkSession.builder.appName(f"veldt {a.job}").getOrCreate(), a)


if __name__ == "__main__":
    main()
