"""The registered queries and their SQL."""

from . import ball_tree, decontaminate, html_text, jaccard_join, mixing, neighbours, quality, secrets, spelling, substring_dedup, token_files, url_filter, whitening

_OPERATORS = {
    "op1_secrets": secrets,
    "op2_mixing": mixing,
    "op3_neighbours": neighbours,
    "op4_url_filter": url_filter,
    "op9_html_text": html_text,
    "op5_token_files": token_files,
    "op6_jaccard_join": jaccard_join,
    "op7_substring_dedup": substring_dedup,
    "op8_decontaminate": decontaminate,
    "op10_quality": quality,
    "op11_whitening": whitening,
    "op12_top_k": ball_tree,
    "op13_spelling": spelling,
}


def queries():
    return {name: module.query for name, module in _OPERATORS.items()}


def oracle_sql():
    return {name: module.SQL for name, module in _OPERATORS.items() if module.SQL}
