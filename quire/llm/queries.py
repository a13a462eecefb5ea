"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import jaccard, line_dedup, mixing, mtree, nndescent, packing, pii, preferences, sharding, toxicity

QUERIES = {
    "op1_mtree": mtree.op1_mtree,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_pii": pii.op3_pii,
    "op4_virtual_slots": sharding.op4_virtual_slots,
    "op5_mix": mixing.op5_mix,
    "op6_nn_descent": nndescent.op6_nn_descent,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_packing": packing.op8_packing,
    "op9_preferences": preferences.op9_preferences,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {
    "op1_mtree": mtree.SQL,
    "op5_mix": mixing.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op9_preferences": preferences.SQL,
}
