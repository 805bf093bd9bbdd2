"""Every query of this subpackage."""

from __future__ import annotations

from duskline.llm import (  # noqa: F401
    decontaminate, divergence, language, licenses, linespread, merkle, mixing, secrets, simhash, spotsigs, surrogates, tokens, urls,
)
from duskline.llm.catalog import ORACLES, QUERIES


def load():
    return QUERIES, ORACLES
