"""evlog: event-log analytics and persistence on Spark DataFrames and Structured Streaming."""

from evlog.functions.payload import (count_non_empty, decode_payload, encode_json, enqueued_seconds,
                                     key_by_constant, non_empty, payload_text)
from evlog.functions.properties import with_properties, with_property_keys
from evlog.operators.counts import (end_positions, fill_idle, running_total, sequence_gaps, window_counts)
from evlog.operators.ledger import (batch_report, format_ledger, ledger_as_of, ledger_audit, ledger_batch,
                                    ledger_merge, ledger_retain, ledger_rows, load_ledger, lost_partitions,
                                    parse_ledger, save_ledger)
from evlog.session import get_session
from evlog.sources.events import (kafka_envelope, read_events, read_partition, to_envelope, union_hubs,
                                  union_partitions)
from evlog.sources.positions import partition_lag, slice_ranges, start_from, total_lag

__all__ = [
    "batch_report", "count_non_empty", "decode_payload", "encode_json", "end_positions", "enqueued_seconds",
    "fill_idle", "format_ledger", "get_session", "kafka_envelope", "key_by_constant", "ledger_as_of",
    "ledger_audit", "ledger_batch", "ledger_merge", "ledger_retain", "ledger_rows", "load_ledger",
    "lost_partitions", "non_empty", "parse_ledger", "partition_lag", "payload_text", "read_events",
    "read_partition", "running_total", "save_ledger", "sequence_gaps", "slice_ranges", "start_from",
    "to_envelope", "total_lag", "union_hubs", "union_partitions", "window_counts", "with_properties",
    "with_property_keys",
]
