"""Runners that misbehave on purpose."""


class Raises:
    """Fails on marked texts; otherwise the length of the text."""

    def __init__(self, batch_size=4):
        self.batch_size = batch_size

    def run(self, inputs):
        if any("BAD" in t for _, t in inputs):
            raise ValueError("bad text")
        return [float(len(t)) for _, t in inputs]


class WrongLength:
    """One result short whenever a batch holds a marked text."""

    def __init__(self, batch_size=4):
        self.batch_size = batch_size

    def run(self, inputs):
        scores = [float(len(t)) for _, t in inputs]
        return scores[:-1] if any("SHORT" in t for _, t in inputs) else scores


class Upper:
    """A rewrite runner in Python."""

    def __init__(self, batch_size=2):
        self.batch_size = batch_size

    def run(self, inputs):
        return [turns[-1].upper() for turns in inputs]


class TextEmbed:
    """An embedding runner that takes texts and brings its own ids."""

    takes = "text"
    supports_dense = True
    supports_sparse = True

    def __init__(self, batch_size=3):
        self.batch_size = batch_size

    def run(self, inputs):
        if any(t == "boom" for t in inputs):
            raise ValueError("boom")
        return [([float(len(t)), 1.0], [0, len(t) + 10, 2], [9.0, 0.5, 9.0]) for t in inputs]
