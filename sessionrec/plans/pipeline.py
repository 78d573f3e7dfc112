"""The whole pipeline: five stages that hand over parquet tables.

preprocess -> candidates -> merge -> features and negative sample -> rankers.
Every stage reads the tables of the stages before and writes its own, so a run can
start again at any stage and survives the loss of executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sessionrec.operators import evaluation as ev
from sessionrec.operators import factorization as fz
from sessionrec.operators import item2vec as i2v
from sessionrec.operators import item_cf as cf
from sessionrec.operators import merge as mg
from sessionrec.operators import rankers as rk
from sessionrec.operators import vectors as vx
from sessionrec.operators.feature_merge import (
    FEATURE_TABLES,
    FeatureTable,
    build_features,
    merge_features,
)
from sessionrec.operators.history import all_history_candidates, hot_sessions
from sessionrec.operators.sampling import sample_negatives
from sessionrec.sources import events as log
from sessionrec.sources.stages import read_stage, write_stage


@dataclass(frozen=True)
class Settings:
    """What a run computes. Defaults are the published full-size values."""

    rules: tuple[cf.PairRule, ...] = cf.RULES
    generators: tuple[mg.Generator, ...] = mg.ALL_GENERATORS
    factors: int = 256
    factor_iterations: int = 20
    user_min_events: int = 20
    vector_size: int = 32
    vector_iterations: int = 10
    candidates: int = 300
    tables: tuple[FeatureTable, ...] = FEATURE_TABLES
    sample_ratio: float | None = None
    negative_ratio: float = 0.5
    folds: tuple[int, ...] = (0, 1, 2)
    targets: tuple[str, ...] = rk.TARGETS
    kind: str = "pointwise"
    ranker: dict = field(default_factory=dict)
    seed: int = 77


class Pipeline:
    """Stage tables of one run under ``root``, a folder all executors share."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.settings = settings or Settings()
        self._hot: dict[str, DataFrame | None] = {}

    def hot(self, name: str) -> DataFrame | None:
        """The long sessions of a log, looked up once per run."""
        if name not in self._hot:
            self._hot[name] = hot_sessions(self.table(name))
        return self._hot[name]

    def table(self, name: str) -> DataFrame:
        return read_stage(self.spark, f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        write_stage(df, f"{self.root}/{name}", partition_by)
        return self.table(name)

    def preprocess(self, train: DataFrame, test: DataFrame, labels: DataFrame | None) -> None:
        """Logs, dense ids and consecutive-item pairs. No labels: submission mode."""
        s = self.settings
        labels = log.empty_labels(self.spark) if labels is None else labels
        whole = log.train_log(train, test)
        if s.sample_ratio is not None:
            whole, test, labels = log.sample_sessions(whole, test, labels, s.sample_ratio, s.seed)
        train = self._write(whole, "train")
        self._write(test, "test")
        self._hot.clear()
        self._write(labels, "labels")
        ids = self._write(fz.item_ids(train), "item_ids")
        self._write(fz.lag_pairs(train, ids, hot=self.hot("train")), "lag_pairs")

    @property
    def labels(self) -> DataFrame | None:
        labels = self.table("labels")
        return None if labels.isEmpty() else labels

    def generate(self) -> None:
        """All generators into one long candidate table, one folder per family."""
        s, train, test = self.settings, self.table("train"), self.table("test")
        names = {g.name for g in s.generators}
        self._write(all_history_candidates(test, self.hot("test")), "candidates/family=history")

        pairs = self._write(cf.item_pairs(train, s.rules), "item_pairs")
        found = cf.item_cf_candidates(test, pairs, s.rules, candidates=s.candidates)
        self._write(found, "candidates/family=item_cf")

        if names & {"item_mf_last", "item_mf_seq"}:
            ids = self.table("item_ids")
            coefs = fz.pair_coefs(self.table("lag_pairs"), train, ids)
            vectors = self._write(
                fz.item_factors(coefs, ids, s.factors, s.factor_iterations, s.seed), "item_mf"
            )
            for seed in ("last", "seq"):
                found = vx.embedding_candidates(test, vectors, f"item_mf_{seed}", seed, s.candidates)
                self._write(found, f"candidates/family=item_mf_{seed}")
        if "user_mf" in names:
            found = fz.user_mf_candidates(
                train, test, s.factors, s.factor_iterations, s.user_min_events, s.candidates, s.seed
            )
            self._write(found, "candidates/family=user_mf")
        if names & {"item2vec_last", "item2vec_seq"}:
            sentences = i2v.item_sentences(train, self.hot("train"))
            model = i2v.fit_item2vec(sentences, s.vector_size, s.vector_iterations, seed=s.seed)
            vectors = self._write(i2v.item2vec_vectors(model), "item2vec")
            for seed in ("last", "seq"):
                found = vx.embedding_candidates(
                    test, vectors, f"item2vec_{seed}", seed, s.candidates
                )
                self._write(found, f"candidates/family=item2vec_{seed}")

    def merge(self) -> DataFrame:
        """Wide candidates with labels and folds (if labelled) and votes."""
        s, labels = self.settings, self.labels
        candidates = self.table("candidates").drop("family")
        merged = mg.wide_candidates(candidates, s.generators)
        if labels is not None:
            labelled = self._write(mg.label_candidates(merged, labels), "labelled")
            merged = mg.add_folds(labelled)
        return self._write(mg.add_votes(merged, s.generators), "merged")

    def features(self) -> DataFrame:
        """Features joined onto the candidates; the sampled training set beside them."""
        s = self.settings
        built = build_features(self.table("train"), self.table("test"), s.tables, self.hot("test"), True)
        tables = [(t, self._write(df, f"features/{t.build.__name__}")) for t, df in built]
        featured = self._write(merge_features(self.table("merged"), tables), "featured")
        if self.labels is not None:
            self._write(sample_negatives(featured, s.negative_ratio, s.seed), "sampled")
        return featured

    def feature_names(self) -> list[str]:
        """Every generator column, vote and feature of the candidate table."""
        keys = {"session", "aid", "fold"}
        return [
            c
            for c in self.table("featured").columns
            if c not in keys and not c.startswith(("target_", "no_target_"))
        ]

    def train(self) -> dict[str, dict[int, object]]:
        """Models per target and fold, saved under ``models``."""
        s, sampled, names = self.settings, self.table("sampled"), self.feature_names()
        models = {}
        for target in s.targets:
            models[target] = rk.train_folds(sampled, target, names, s.folds, s.kind, **s.ranker)
            for fold, model in models[target].items():
                model.write().overwrite().save(f"{self.root}/models/{s.kind}_{target}_{fold}")
        return models

    def load_models(self, root: str | None = None) -> dict[str, dict[int, object]]:
        """The models that ``train`` saved, of this run or of the run under ``root``."""
        s, at = self.settings, f"{(root or self.root).rstrip('/')}/models"
        return {
            target: {fold: rk.load_model(f"{at}/{s.kind}_{target}_{fold}", s.kind) for fold in s.folds}
            for target in s.targets
        }

    def score(self, models: dict[str, dict[int, object]] | None = None) -> DataFrame:
        """Scores of all candidates, out of fold where folds exist; saved models by default."""
        s, featured, names = self.settings, self.table("featured"), self.feature_names()
        models = self.load_models() if models is None else models
        by_fold = "fold" in featured.columns
        for target, by in models.items():
            scores = rk.predict_folds(by, featured, target, names, s.kind, by_fold)
            self._write(scores.drop("model", "target"), f"scores/model={s.kind}/target={target}", ("fold",))
        return self.table("scores")

    def evaluate(self, k: int = 20) -> DataFrame:
        """Recall of the top lists of every target (one row)."""
        lists = None
        for name, event_type in log.TARGETS.items():
            target = f"target_{name}"
            if target not in self.settings.targets:
                continue
            scores = self.table("scores").filter(f"target = '{target}'")
            top = self._write(ev.top_lists(scores, k), f"lists/{name}")
            part = top.selectExpr("session", "y_pred", f"cast({event_type} AS tinyint) AS type")
            lists = part if lists is None else lists.unionByName(part)
        return ev.recall_at_k(self.table("labels"), lists, k)

    def run(self, train: DataFrame, test: DataFrame, labels: DataFrame) -> DataFrame:
        """All stages on labelled data; returns the final recall."""
        self.preprocess(train, test, labels)
        self.generate()
        self.merge()
        self.features()
        self.score(self.train())
        return self.evaluate()
