"""Document question answering over mixed-format archives, as Spark pipelines."""

from folioscope.lexicon import DEFAULT, Lexicon

__all__ = ["DEFAULT", "Lexicon"]
