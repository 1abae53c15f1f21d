"""All queries of the core; the llm package adds its own where it is there."""

from __future__ import annotations

from foliant.plans import composing, extracting, judging, keeping, more, relational, resolving, retrieving, textual
from foliant.registry import Registry


#: Entry points that are one operator and no more: the operator answers under both names.
ENTRY = {
    "cq_cloud": "agg_surname_cloud", "cq_surnames": "agg_surname_groups", "cq_stats": "agg_corpus_stats", "cq_featured": "win_featured_pick", "cq_family": "gr_family_tree",
    "cq_graph_stats": "agg_graph_stats", "ir_entity_search": "agg_search_entities", "src_pages_txt": "jn_prefer_corrected", "src_catalog": "src_catalog_list", "agg_cli_stats": "agg_corpus_stats",
}


def core() -> Registry:
    """The core's queries."""
    reg = Registry()
    relational.register(reg)
    textual.register(reg)
    more.register(reg)
    for plans in (extracting, retrieving, resolving, judging, keeping, composing):
        reg.include(plans.reg)
    for name, operator in ENTRY.items():
        reg.add(name, reg.builders[operator], reg.sql.get(operator))
    return reg
