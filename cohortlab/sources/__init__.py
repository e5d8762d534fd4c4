from cohortlab.sources.cache import cut_lineage, persist_parts, unpersist_parts
from cohortlab.sources.csv import read_csv, write_csv
from cohortlab.sources.views import register_views, sql_over, view_sql

__all__ = ["cut_lineage", "persist_parts", "unpersist_parts", "read_csv", "write_csv",
           "register_views", "sql_over", "view_sql"]
