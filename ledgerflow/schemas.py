"""Explicit schemas and fixed domain values.

No schema is inferred: every source is read with one of the StructTypes below and money is
``DECIMAL(18,2)`` from the edge on.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results (names, enums, constants).
# ---------------------------------------------------------------------------------------------

# raw CSV column -> canonical column (both spellings of the sender's new balance are accepted)
RAW_TO_CANONICAL = {
    "step": "time_step",
    "type": "transaction_type",
    "amount": "amount",
    "nameOrig": "sender_id",
    "oldbalanceOrg": "sender_old_balance",
    "newbalanceOrig": "sender_new_balance",
    "newbalanceOrg": "sender_new_balance",
    "nameDest": "receiver_id",
    "oldbalanceDest": "receiver_old_balance",
    "newbalanceDest": "receiver_new_balance",
    "isFraud": "is_fraud",
    "isFlaggedFraud": "is_flagged_fraud",
}

# longest texts that the stored transaction columns take; a longer one is a write failure
TEXT_LENGTHS = {"transaction_type": 20, "sender_id": 32, "receiver_id": 32}

TRANSACTION_TYPES = ["PAYMENT", "CASH_IN", "CASH_OUT", "TRANSFER", "DEBIT"]

# alert enums
ALERT_TYPES = [
    "suspicious_amount",
    "new_merchant",
    "unusual_pattern",
    "high_risk_location",
    "velocity_check",
    "device_mismatch",
]
ALERT_STATUSES = ["open", "investigating", "resolved", "false_positive", "confirmed_fraud"]

# payment status domain used by the consistency check
PAYMENT_STATUSES = ["completed", "pending", "failed", "fraudulent", "cancelled"]

# amount bins, right-closed: (0,100] small, (100,1000] medium, (1000,10000] large, (10000,inf) very_large
AMOUNT_BINS = [(100, "small"), (1000, "medium"), (10000, "large")]
AMOUNT_TOP_LABEL = "very_large"
AMOUNT_CATEGORIES = ["small", "medium", "large", "very_large"]

# risk_category bins of the processed table: (0,0.3] low, (0.3,0.7] medium, (0.7,1] high
RISK_BINS = [(0.3, "low"), (0.7, "medium"), (1.0, "high")]

HIGH_VALUE_THRESHOLD = 10000
TRANSACTION_EPOCH = "2017-01-01 00:00:00"  # time_step 0
USD_FACTOR = 1.1  # flat conversion of the processed table
RISK_WEIGHTS = {"is_fraud": 0.8, "high_value": 0.3, "unusual": 0.2, "ratio": 0.1}
RATIO_THRESHOLD = 0.5
DAILY_HIGH_RISK = 0.7
DAILY_CRITICAL_RISK = 0.9

# data-quality thresholds
MIN_AMOUNT = 0.01
MAX_AMOUNT = 1000000.0
UNREASONABLE_AMOUNT = 100000
DQ_WARN_ABOVE = 100
DQ_ERROR_ABOVE = 1000

# placeholders used when a stream message lacks a field
STREAM_DEFAULTS = {
    "time_step": 0,
    "transaction_type": "PAYMENT",
    "amount": 0.0,
    "sender_id": "C123456789",
    "sender_old_balance": 0.0,
    "sender_new_balance": 0.0,
    "receiver_id": "M123456789",
    "receiver_old_balance": 0.0,
    "receiver_new_balance": 0.0,
    "is_fraud": False,
    "is_flagged_fraud": False,
    "risk_score": 0.0,
}
REQUIRED_STREAM_FIELDS = ["time_step", "transaction_type", "amount", "sender_id", "receiver_id"]
UPSERT_KEY = ["time_step", "sender_id", "receiver_id"]
UPSERT_FIELDS = [
    "amount",
    "transaction_type",
    "sender_old_balance",
    "sender_new_balance",
    "receiver_old_balance",
    "receiver_new_balance",
    "is_fraud",
    "is_flagged_fraud",
    "risk_score",
]

# currency rates for amount_usd by currency (a parameter table; these are the defaults)
DEFAULT_RATES = {"USD": 1.0, "EUR": 1.1, "GBP": 1.3}

# ---------------------------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------------------------

RAW_TRANSACTION = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("nameOrig", T.StringType()),
        T.StructField("oldbalanceOrg", MONEY),
        T.StructField("newbalanceOrig", MONEY),
        T.StructField("nameDest", T.StringType()),
        T.StructField("oldbalanceDest", MONEY),
        T.StructField("newbalanceDest", MONEY),
        T.StructField("isFraud", T.IntegerType()),
        T.StructField("isFlaggedFraud", T.IntegerType()),
    ]
)

TRANSACTION = T.StructType(
    [
        T.StructField("time_step", T.IntegerType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("sender_id", T.StringType()),
        T.StructField("sender_old_balance", MONEY),
        T.StructField("sender_new_balance", MONEY),
        T.StructField("receiver_id", T.StringType()),
        T.StructField("receiver_old_balance", MONEY),
        T.StructField("receiver_new_balance", MONEY),
        T.StructField("is_fraud", T.BooleanType()),
        T.StructField("is_flagged_fraud", T.BooleanType()),
    ]
)

# the stored transactions table of the stream job
STORED_TRANSACTION = T.StructType(
    TRANSACTION.fields
    + [
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# the processed warehouse table (fixed DDL; ratio and score are narrow decimals at rest)
PROCESSED_TRANSACTION = T.StructType(
    [
        T.StructField("time_step", T.IntegerType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("amount", T.DecimalType(10, 2)),
        T.StructField("amount_usd", T.DecimalType(10, 2)),
        T.StructField("sender_id", T.StringType()),
        T.StructField("sender_old_balance", T.DecimalType(10, 2)),
        T.StructField("sender_new_balance", T.DecimalType(10, 2)),
        T.StructField("receiver_id", T.StringType()),
        T.StructField("receiver_old_balance", T.DecimalType(10, 2)),
        T.StructField("receiver_new_balance", T.DecimalType(10, 2)),
        T.StructField("is_fraud", T.BooleanType()),
        T.StructField("is_flagged_fraud", T.BooleanType()),
        T.StructField("transaction_date", T.TimestampNTZType()),
        T.StructField("transaction_hour", T.IntegerType()),
        T.StructField("transaction_day", T.IntegerType()),
        T.StructField("amount_category", T.StringType()),
        T.StructField("high_value_transaction", T.BooleanType()),
        T.StructField("unusual_amount", T.BooleanType()),
        T.StructField("balance_change_ratio", T.DecimalType(5, 4)),
        T.StructField("risk_score", T.DecimalType(3, 2)),
        T.StructField("risk_category", T.StringType()),
        T.StructField("hour_of_day", T.IntegerType()),
        T.StructField("day_of_week", T.StringType()),
        T.StructField("is_valid", T.BooleanType()),
        T.StructField("processed_at", T.TimestampType()),
    ]
)

PAYMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("merchant_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_email", T.StringType()),
        T.StructField("merchant_name", T.StringType()),
        T.StructField("merchant_category", T.StringType()),
    ]
)

FRAUD_ALERT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("transaction_id", T.LongType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("payment_method", T.StringType()),
    ]
)

# a message as a topic source delivers it (the Kafka source's own columns)
TOPIC_MESSAGE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# the JSON body of a transaction message (all fields optional: presence is checked separately)
TRANSACTION_MESSAGE_BODY = T.StructType(
    [
        T.StructField("time_step", T.StringType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("amount", T.StringType()),
        T.StructField("sender_id", T.StringType()),
        T.StructField("sender_old_balance", T.StringType()),
        T.StructField("sender_new_balance", T.StringType()),
        T.StructField("receiver_id", T.StringType()),
        T.StructField("receiver_old_balance", T.StringType()),
        T.StructField("receiver_new_balance", T.StringType()),
        T.StructField("is_fraud", T.StringType()),
        T.StructField("is_flagged_fraud", T.StringType()),
        T.StructField("risk_score", T.StringType()),
    ]
)
