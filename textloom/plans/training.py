"""Training a pipeline's model from a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.models import Bpe, Unigram, WordLevel, WordPiece
from textloom.operators.trainers import BpeTrainer, UnigramTrainer, WordLevelTrainer, WordPieceTrainer, word_counts
from textloom.plans.pipeline import TextPipeline
from textloom.sources.tables import batches_of_texts, text_lines

_MODELS = {WordLevelTrainer: WordLevel, BpeTrainer: Bpe, WordPieceTrainer: WordPiece, UnigramTrainer: Unigram}


def train(pipeline: TextPipeline, trainer, texts: DataFrame, text_col: str = "text") -> TextPipeline:
    """The pipeline with a trained model of the same kind, and the trainer's special tokens added."""
    made = _MODELS[type(trainer)]
    if not isinstance(pipeline.model, made):
        raise ValueError(f"{type(trainer).__name__} can only train a {made.__name__}")
    rows = batches_of_texts(texts, text_col)
    normalize = pipeline.normalizer.column(F.col("text")) if pipeline.normalizer else None
    counts = word_counts(rows, "text", pipeline.splitter, normalize)
    unk = {"unk_token": pipeline.model.unk_token} if isinstance(trainer, (WordLevelTrainer, WordPieceTrainer)) else {}
    return pipeline.with_(model=trainer.train(counts, **unk)).with_special_tokens(list(trainer.special_tokens))


def train_from_files(spark: SparkSession, pipeline: TextPipeline, trainer, paths: str | list[str]) -> TextPipeline:
    return train(pipeline, trainer, text_lines(spark, paths))
