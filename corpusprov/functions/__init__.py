"""Column expressions: URL hosts and domains, names, snapshot ids, responses."""

from corpusprov.functions.domains import (
    SuffixRules,
    domain_sql,
    domains_by_join,
    register_domain_functions,
    url_host_sql,
    with_domain,
    with_host,
)
from corpusprov.functions.names import (
    basename,
    clean_name,
    fold_crawl_parent,
    last_part,
    output_name,
    pair_key,
    snapshot_monday,
    snapshot_part,
    year_month_date,
)
from corpusprov.functions.urls import (
    URL_PATTERN,
    dict_text_url,
    json_url,
    path_facets,
)

__all__ = [
    "SuffixRules", "domain_sql", "domains_by_join", "register_domain_functions", "url_host_sql", "with_domain", "with_host",
    "basename", "clean_name", "fold_crawl_parent", "last_part", "output_name", "pair_key",
    "snapshot_monday", "snapshot_part", "year_month_date",
    "URL_PATTERN", "dict_text_url", "json_url", "path_facets",
]
