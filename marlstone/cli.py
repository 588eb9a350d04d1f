"""Generate references and labeled transactions: `python -m marlstone.cli --refs 3000 --payloads 1000`."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import config, generate
from .plans.scoring import label, write_labeled
from .session import session
from .shared import materialize
from .sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--refs", type=int, default=200)
    p.add_argument("--payloads", type=int, default=1000)
    p.add_argument("--fraud-ratio-refs", type=float, default=0.30)
    p.add_argument("--fraud-ratio-payloads", type=float, default=0.30)
    p.add_argument("--norm-cfg", help="JSON of the normalization constants; built in if not given")
    p.add_argument("--mcc-cfg", help="JSON of the category risks; built in if not given")
    p.add_argument("--refs-out", default="references")
    p.add_argument("--reuse-refs", action="store_true", help="read references from --refs-in instead of making them")
    p.add_argument("--refs-in", default="references")
    p.add_argument("--payloads-out", default="test-data")
    p.add_argument("--refs-seed", type=int, default=42)
    p.add_argument("--payloads-seed", type=int, default=4242)
    p.add_argument("--pretty-json", action="store_true")
    p.add_argument("--randomize-payload-dates", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    spark = session("marlstone-generate")
    norm = config.read_normalization(spark, o.norm_cfg) if o.norm_cfg else None
    risks = config.read_mcc_risk(spark, o.mcc_cfg) if o.mcc_cfg else None
    if o.reuse_refs:
        refs = readers.stored_references(spark, o.refs_in)
    else:
        readers.store_references(generate.references(spark, o.refs, o.fraud_ratio_refs, o.refs_seed, risks, norm), o.refs_out)
        refs = readers.stored_references(spark, o.refs_out)
    made = generate.transactions(spark, o.payloads, o.fraud_ratio_payloads, o.payloads_seed, o.randomize_payload_dates, list(risks) if risks else None)
    sums = readers.sha256_of_files(spark, f"{o.refs_in if o.reuse_refs else o.refs_out}/*.parquet")
    checksum = F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ""), 256)
    labeled = materialize(label(made, refs, risks=risks, norm=norm), "labeled")
    write_labeled(labeled, sums.agg(checksum).first()[0], o.payloads_out, o.pretty_json)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
