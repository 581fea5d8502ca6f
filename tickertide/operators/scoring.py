"""Batched scoring of texts by a pluggable model, and the enriched row built on it."""

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tickertide.functions.quality import quality_flags
from tickertide.functions.sentiment import (
    conviction,
    lower_keys,
    sentiment_from_probs,
    source_weight,
    stance_from_probs,
)
from tickertide.functions.text import dedup_key, normalize_text
from tickertide.operators.tickers import extract_tickers
from tickertide.schema import ENRICHED_POST, SCORES

# One scorer call per batch of texts; each returns one label → probability dict per text.
BatchScorer = Callable[[list[str]], list[dict]]
# Called once per worker process: (finance, emotion, stance).
ScorerFactory = Callable[[], tuple[BatchScorer, BatchScorer, BatchScorer]]

# Fixed value: texts in one scorer call.
BATCH_SIZE = 16

# The scorers of this worker process, by the name of the call that made them.
_loaded: dict[str, tuple[BatchScorer, BatchScorer, BatchScorer]] = {}


def _scorers(name: str, make_scorers: ScorerFactory) -> tuple[BatchScorer, BatchScorer, BatchScorer]:
    if name not in _loaded:
        _loaded[name] = make_scorers()
    return _loaded[name]


def length_batches(texts: list[str], size: int, chars: int | None) -> Iterator[list[str]]:
    """The distinct texts, short ones first, in runs of at most ``size`` texts and ``chars`` padded characters."""
    run: list[str] = []
    for text in sorted(set(texts), key=lambda t: (len(t or ""), t or "")):
        over = chars is not None and len(text or "") * (len(run) + 1) > chars
        if run and (len(run) == size or over):
            yield run
            run = []
        run.append(text)
    if run:
        yield run


def score_posts(
    df: DataFrame,
    make_scorers: ScorerFactory,
    text_col: str = "text",
    batch_size: int = BATCH_SIZE,
    batch_chars: int | None = None,
) -> DataFrame:
    """Add a ``scores`` struct of three label maps.

    A scorer gets texts of about the same length together, since a model pads the texts of a
    call to the longest one: at most ``batch_size`` of them and, if ``batch_chars`` is given, at most
    that many characters after padding (a longer text is a call of its own).  Equal texts of
    an Arrow batch are scored once; a scorer must not depend on a text's company or place.

    Only the whole normalized text crosses to Python, in Arrow batches; the models are
    loaded once per worker process and every other column stays in the JVM.
    """
    size, name = batch_size, uuid.uuid4().hex

    @pandas_udf(SCORES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finance, emotion, stance = _scorers(name, make_scorers)

        def labelled(scorer, texts):
            out = {}
            for chunk in length_batches(texts, size, batch_chars):
                results = scorer(chunk)
                if len(results) != len(chunk):
                    raise ValueError("a scorer must return one result per text")
                for text, r in zip(chunk, results):
                    out[text] = {str(k).lower(): float(v) for k, v in r.items()}
            return out

        for batch in batches:
            texts = batch.tolist()
            found = [labelled(scorer, texts) for scorer in (finance, emotion, stance)]
            yield pd.DataFrame(
                {name: [by[t] for t in texts] for name, by in zip(SCORES.fieldNames(), found)}
            )

    return df.withColumn("scores", run(normalize_text(text_col)))


def enrich(
    scored: DataFrame,
    allow: DataFrame | Iterable[str] | None = None,
    enriched_at: Column | None = None,
) -> DataFrame:
    """Raw posts with ``scores`` to enriched posts; built-in columns only.

    A ``dedup_key`` that is already there is kept rather than hashed again.
    """
    with_tickers = extract_tickers(scored, "text", allow)
    staged = with_tickers.withColumns(
        {
            "_fin": sentiment_from_probs("scores.finance"),
            "_stance": stance_from_probs("scores.stance"),
        }
    )
    derived = {
        "language": F.lit(None).cast("string"),
        "finbert_pos": F.col("_fin.pos"),
        "finbert_neg": F.col("_fin.neg"),
        "finbert_neutral": F.col("_fin.neutral"),
        "finbert_score": F.col("_fin.score"),
        "emotions": lower_keys("scores.emotion"),
        "stance_label": F.col("_stance.label"),
        "stance_confidence": F.col("_stance.confidence"),
        "stance_probs": F.col("_stance.probs"),
        "conviction": conviction(
            F.col("_stance.label"), F.col("_stance.confidence"), F.col("_fin.score")
        ),
        "source_weight": source_weight("source"),
        "dedup_key": dedup_key("url", "text"),
        "confidence": F.lit(0.5),
        "flags": quality_flags("tickers", "text"),
        "enriched_at": enriched_at if enriched_at is not None else F.current_timestamp(),
    }
    if "dedup_key" in scored.columns:
        del derived["dedup_key"]
    return staged.select(
        *[
            derived[name].alias(name) if name in derived else F.col(name)
            for name in ENRICHED_POST.fieldNames()
        ]
    )
