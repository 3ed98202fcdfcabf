from .tables import (events_interactions, interactions_from_table,
                     order_line_interactions, table_path)
from .text import (load_interactions, parse_records, read_record_blocks, record_text,
                   sample_first_records, write_review_text)

__all__ = [
    "events_interactions", "interactions_from_table", "order_line_interactions",
    "table_path", "load_interactions", "parse_records", "read_record_blocks",
    "record_text", "sample_first_records", "write_review_text",
]
