"""Runners named by ``module:Class``, with limits of their own, as models have them."""

from __future__ import annotations

from quillmesh.operators.runners import HEAD_B, HEAD_B_OUT, HEAD_W, HEAD_W_OUT
from quillmesh.operators.inference import ScoreHead

HEAD = ScoreHead(HEAD_W, HEAD_B, HEAD_W_OUT, HEAD_B_OUT)


class LengthRatioRunner:
    """Shorter length over longer one. Refuses texts above ``max_chars`` and leaves out those below ``min_chars``.

    Leaving out gives fewer results than inputs, which the caller must notice.
    """

    def __init__(self, batch_size: int = 16, min_chars: int = 0, max_chars: int = 1 << 30) -> None:
        self.batch_size, self.min_chars, self.max_chars = batch_size, min_chars, max_chars

    def run(self, inputs: list[tuple[str, str]]) -> list[float]:
        if any(len(text) > self.max_chars for _, text in inputs):
            raise ValueError(f"text of more than {self.max_chars} characters")
        kept = [(len(query), len(text)) for query, text in inputs if len(text) >= self.min_chars]
        return [min(pair) / max(*pair, 1) for pair in kept]


class LengthEncoderRunner:
    """A vector of four length features per pair, for a head outside the model."""

    def __init__(self, batch_size: int = 256) -> None:
        self.batch_size = batch_size

    def run(self, inputs: list[tuple[str, str]]) -> list[list[float]]:
        sizes = [(len(query), len(text)) for query, text in inputs]
        return [[min(q, t) / max(q, t, 1), q / (q + t + 1), 1 / (1 + q / 100), 1 / (1 + t / 1000)] for q, t in sizes]
