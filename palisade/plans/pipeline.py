"""The three batch runs: training, reconstruction with learned models, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import constants as C
from palisade import session
from palisade.functions import scoring
from palisade.operators import (
    evaluate, explain, forest, fusion, normalize, ocsvm, scaling, sequence, synth,
)
from palisade.sources import models as store

SCALED = [f"{n}_scaled" for n in C.FLOW_FEATURES]


@dataclass
class FlowModel:
    scale: dict[str, tuple[float, float]]
    trees: forest.Forest
    cut: float


@dataclass
class Models:
    flow: FlowModel | None
    text: dict[str, ocsvm.TextModel]

    @property
    def tags(self) -> list[str]:
        return ([C.FLOW_TAG] if self.flow else []) + list(self.text)


# --- training --------------------------------------------------------------------------------

def train_flow(flows: DataFrame, root: str) -> None:
    """Scaler, forest and cut from flows with ``seq``; stored under ``root``."""
    spark = flows.sparkSession
    store.save(scaling.robust_stats(flows), root, "scaler")
    by = scaling.scale_map(store.load(spark, root, "scaler"))
    scaled = scaling.scaled(flows, by)
    store.save(forest.fit(scaled, SCALED), root, "forest")
    trees = forest.load(store.load(spark, root, "forest"))
    scores = session.materialize(
        forest.scored(scaled, trees, SCALED).select("score"), "flow-scores")
    cut = forest.cut_score(scores)
    store.save(spark.createDataFrame([(cut,)], "cut double"), root, "forest_cut")


def train_text(layers: dict[str, DataFrame], root: str, **options) -> None:
    """One model per layer from its baseline lines; stored under ``root``."""
    spark = next(iter(layers.values())).sparkSession
    fitted = ocsvm.fit(ocsvm.corpus(layers), list(layers), **options)
    for part, table in ocsvm.to_tables(spark, fitted).items():
        store.save(table, root, part)


def load_models(spark: SparkSession, root: str) -> Models:
    """Whatever was trained; a layer without a model is simply absent."""
    flow = None
    nodes = store.load(spark, root, "forest")
    if nodes is not None:
        flow = FlowModel(scaling.scale_map(store.load(spark, root, "scaler")),
                         forest.load(nodes),
                         store.load(spark, root, "forest_cut").first()["cut"])
    text = {}
    vocab = store.load(spark, root, "vocab")
    if vocab is not None:
        text = ocsvm.from_tables(vocab, store.load(spark, root, "svm"),
                                 store.load(spark, root, "svm_settings"))
    return Models(flow, text)


# --- scoring ---------------------------------------------------------------------------------

def score_flows(frames: DataFrame, model: FlowModel, scaled: bool = True) -> DataFrame:
    """Adds ``prediction``; ``scaled=False`` feeds raw values to the same forest."""
    if scaled:
        ready, names = scaling.scaled(frames, model.scale), SCALED
    else:
        ready, names = frames, C.FLOW_FEATURES
    return forest.predicted(forest.scored(ready, model.trees, names), model.cut)


def score_frames(frames: DataFrame, models: Models, explained: bool = True,
                 scaled: bool = True) -> DataFrame:
    """Routed frames with ``base`` and, for flagged ones, ``forensics``.

    Flows and text go through different Python steps, so each branch reads only its rows.
    The scored table is written once: correlation reads it twice.
    """
    keep = ["seq", "ts", "src_ip", "tag", "payload", "act", "dataset", "base", "forensics"]
    keep = [c for c in keep if c in (*frames.columns, "base", "forensics")]
    none = F.lit(None).cast("array<string>")
    parts = []
    if models.flow:
        flows = score_flows(frames.where(F.col("model_tag") == C.FLOW_TAG), models.flow, scaled)
        flows = flows.withColumn("base", scoring.verdict(F.col("prediction")))
        parts.append((flows, "flows"))
    if models.text:
        texts = frames.where(F.col("model_tag").isin(list(models.text)))
        texts = ocsvm.predicted(ocsvm.decided(texts, models.text))
        parts.append((texts.withColumn("base", scoring.verdict(F.col("prediction"))), "texts"))
    out = None
    for part, name in parts:
        if explained:
            held = session.materialize(part, f"scored-{name}")
            calm = held.where(F.col("base") == 0).withColumn("forensics", none)
            flagged = held.where(F.col("base") > 0)
            if name == "flows":
                names = SCALED if scaled else C.FLOW_FEATURES
                shown = explain.with_shapley(flagged, models.flow.trees, names)
                shown = shown.withColumn(
                    "forensics", explain.flow_evidence(F.col("shap"), C.FLOW_FEATURES))
            else:
                shown = explain.with_word_weights(flagged, models.text)
                shown = shown.withColumn("forensics", explain.text_evidence(F.col("words")))
            part = calm.select(keep).unionByName(shown.select(keep))
        else:
            part = part.withColumn("forensics", none).select(keep)
        out = part if out is None else out.unionByName(part)
    return session.materialize(out, "scored")


def reconstruct(frames: DataFrame, models: Models) -> tuple[DataFrame, DataFrame]:
    """Verdicts of all frames and the alerts among them.

    ``frames`` carry one running ``seq`` over all datasets, and ``ts`` as timestamp.
    """
    routed = normalize.route_to_models(
        normalize.enrich(normalize.with_defaults(frames)), models.tags)
    scored = score_frames(routed, models)
    return fusion.verdicts(scored), fusion.alerts(scored)


# --- evaluation --------------------------------------------------------------------------------

def evaluation(frames: DataFrame, datasets: list[str], models: Models, start: int,
               seed: int = 42) -> DataFrame:
    """Measures of every layer's model and of the fusion on sampled frames and attacks.

    The flow model gets unscaled values here when judged alone, as a specialist.
    """
    sampled = sequence.sample_per_dataset(frames, seed=seed)
    mixed = normalize.with_defaults(synth.inject(sampled.drop("ts"), datasets, start))
    ordered = sequence.chain(sequence.shuffle_order(mixed, seed), datasets)
    drawn = session.materialize(
        ordered.withColumn("ts", F.lit(C.INJECTED_TS[:-1]).cast("timestamp_ntz")), "drawn")

    everything = normalize.route_to_models(drawn.withColumn(
        "tag", normalize.text.refined_layer(F.col("payload"), F.col("act"))), models.tags)
    alone = score_frames(everything, models, explained=False, scaled=False)
    fused = score_frames(normalize.route_to_models(normalize.enrich(drawn), models.tags),
                         models, explained=False)
    layers = evaluate.confusion(evaluate.specialist_judgements(alone), "tag")
    total = evaluate.confusion(evaluate.fusion_judgements(
        drawn, fusion.alerts(fused))).withColumn("tag", F.lit("FUSION"))
    return evaluate.measures(layers.unionByName(total))
