"""Spark-native implicit-feedback recommender: element-wise ALS with
popularity-weighted missing data, leave-one-out HR/NDCG evaluation."""

from .config import ModelConfig, RuntimeConfig
from .plans.end_to_end import run, save_artifacts
from .plans.prepare import Prepared, prepare
from .plans.train import Model, train
from .operators.scoring import evaluate, recommend_topk
from .session import get_session

__all__ = ["ModelConfig", "RuntimeConfig", "Prepared", "prepare", "Model", "train",
           "evaluate", "recommend_topk", "run", "save_artifacts", "get_session"]
