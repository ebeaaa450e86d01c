"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from . import ball_dedup, bpe, fill_middle, license_scan, mixing, periodic_runs, ppm, probminhash, simhash, toxicity, transport, url_filter, warc_fixity
from .common import bound_batches


def _bounded(query: Callable) -> Callable:
    @wraps(query)
    def run(spark, sf_dir):
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_warc_fixity": warc_fixity.op1_warc_fixity,
    "op2_ppm_language": ppm.op2_ppm_language,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_simhash": simhash.op4_simhash,
    "op5_transport_stream": transport.op5_transport_stream,
    "op6_near_duplicates": probminhash.op6_near_duplicates,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_ball_dedup": ball_dedup.op11_ball_dedup,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
QUERIES = {name: _bounded(query) for name, query in QUERIES.items()}
ORACLES = {
    "op1_warc_fixity": warc_fixity.OP1_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
}
