"""Schemas of the data model. Numbers are declared double: writers drop `.0`, so inference would vary by file."""

from __future__ import annotations

_PAYLOAD = {
    "id": "string",
    "transaction": "struct<amount:double,installments:int,requested_at:string>",
    "customer": "struct<avg_amount:double,tx_count_24h:int,known_merchants:array<string>>",
    "merchant": "struct<id:string,mcc:string,avg_amount:double>",
    "terminal": "struct<is_online:boolean,card_present:boolean,km_from_home:double>",
    "last_transaction": "struct<timestamp:string,km_from_current:double>",
}

PAYLOAD = ", ".join(f"{k} {v}" for k, v in _PAYLOAD.items())
REFERENCE = "vector array<double>, label string"
ENTRY = f"request struct<{','.join(f'{k}:{v}' for k, v in _PAYLOAD.items())}>, expected_approved boolean, expected_fraud_score double"
TEST_FILE = f"references_checksum_sha256 string, entries array<struct<{ENTRY.replace('request struct', 'request:struct').replace(', expected_approved ', ',expected_approved:').replace(', expected_fraud_score ', ',expected_fraud_score:')}>>"
TEST_HEADER = "references_checksum_sha256 string, stats struct<total:long,fraud_count:long,legit_count:long,fraud_rate:double,legit_rate:double,edge_case_count:long,edge_case_rate:double>"
RESPONSE = "idx long, approved boolean, status int, duration_ms double"
PARTICIPANT = "id string, repo string"
DIMENSIONS = (
    "amount", "installments", "amount_vs_avg", "hour_of_day", "day_of_week", "minutes_since_last_tx", "km_from_last_tx",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg_amount",
)
