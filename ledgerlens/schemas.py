"""Column types of the domain's tables; nothing is inferred."""

from __future__ import annotations

RULE = "rule_id string, product string, min_credit int, min_income double, max_dti double, min_tenure int"
RULE_VERSION = f"{RULE}, valid_from timestamp, retired boolean"
TRANSACTION = "txn_id string, account_id string, amount decimal(18,2), ts timestamp_ntz, type string, tags array<string>"
CUSTOMER = "customer_id string, name string, tier string, lifetime_value decimal(18,2), city string"
PURCHASE = "order_id string, customer_id string, category string, amount decimal(18,2), store_city string"
PAYMENT = "id string, account_id string, amount decimal(18,2), type string, status string, ts timestamp, fraud_score double"
PAYMENT_REQUEST = "txn_id bigint, customer_id bigint, amount double, merchant_id string"
DEBIT_REQUEST = "seq bigint, ts timestamp, account_id string, request_id string, amount_cents bigint"
BREAKER_CALL = "seq bigint, ts timestamp, service string, failed boolean"
EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
