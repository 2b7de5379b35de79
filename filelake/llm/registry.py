"""All corpus queries and their SQL."""

from . import bpe, chat, collocations, decontam, fingerprints, langid, linededup, neardup, ngramjoin, prefixtrie, quality, warc, wordpiece

MODULES = (chat, bpe, warc, quality, linededup, neardup, ngramjoin, langid, decontam, wordpiece, fingerprints, prefixtrie, collocations)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
