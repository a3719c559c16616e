"""Queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from . import chat, divergence, kdtree, merkle
from .chat import op3_chat
from .divergence import op12_divergence
from .hilbert import op5_neighbours
from .jaccard import op11_jaccard
from .kdtree import op9_topk
from .licenses import op8_licenses
from .merkle import op13_manifest
from .mixing import op4_mixing
from .secrets import op2_secrets
from .sentencepieces import op1_sentencepiece
from .simhash import op7_simhash
from .suffixdedup import op6_passages
from .toxicity import op10_toxicity


def queries() -> dict:
    return {"op1_sentencepiece": op1_sentencepiece, "op2_secrets": op2_secrets, "op3_chat": op3_chat, "op4_mixing": op4_mixing, "op5_neighbours": op5_neighbours, "op6_passages": op6_passages, "op7_simhash": op7_simhash, "op8_licenses": op8_licenses, "op9_topk": op9_topk, "op10_toxicity": op10_toxicity, "op11_jaccard": op11_jaccard, "op12_divergence": op12_divergence, "op13_manifest": op13_manifest}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.ORACLE_SQL, "op9_topk": kdtree.ORACLE_SQL, "op12_divergence": divergence.ORACLE_SQL, "op13_manifest": merkle.ORACLE_SQL}
