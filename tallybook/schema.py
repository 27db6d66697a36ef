"""Column names, schemas and the fixed values used as parameter defaults."""

from pyspark.sql import types as T

# Fixed values (domains of the ledger), in their natural order.
CLASSIFICATIONS = [
    "spesa", "shopping", "ristoranti", "asporto", "viaggi", "salute",
    "esperienze", "abbonamenti", "auto", "casa", "utenze",
]
CATEGORY_GROUPS = {
    "per_vivere": ["spesa", "shopping", "ristoranti", "asporto", "viaggi",
                   "salute", "esperienze", "abbonamenti"],
    "per_auto": ["auto"],
    "per_casa": ["casa"],
    "utenze": ["utenze"],
}
PERSONAL_FILE = "spesa individuale"
MANUAL_FILES = ["spesa individuale", "spesa condivisa"]
CHANNEL_WEB, CHANNEL_SHOP = "online", "negozio"
TOTAL_LABEL = "Totale"
MEAN_LABEL = "Mean"
CARD_PAYMENT_MARK = "CARTIMPRONTA"
KEPT_EXCEPTION = "cartimpronta"
STAMP_DUTY = {"after": "2025-03-01", "threshold": "77.47", "fee": "2.00", "label": "imposta di bollo"}
BANK_BLANK_PATCH = ("31/03/22", "01/04/22", "- 3,60")
MONTH_NAMES_IT = [
    "Gennaio", "Febbraio", "Marzo", "Aprile", "Maggio", "Giugno",
    "Luglio", "Agosto", "Settembre", "Ottobre", "Novembre", "Dicembre",
]

# The ledger owners are data, not code: callers pass their own list.
OWNERS = ["owner_a", "owner_b"]

RAW_LEDGER = T.StructType([
    T.StructField("txn_date", T.DateType()),
    T.StructField("booking_date", T.DateType()),
    T.StructField("description", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("owner", T.StringType()),
])

TAGS = T.StructType([
    T.StructField("std_description", T.StringType()),
    T.StructField("classification", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("update_exception", T.BooleanType()),
    T.StructField("essential", T.IntegerType()),
    T.StructField("recurrent", T.IntegerType()),
    T.StructField("product", T.IntegerType()),
])

LEDGER = T.StructType(RAW_LEDGER.fields + TAGS.fields)

RULE_FIELDS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("classification", T.StringType()),
    T.StructField("descriptions", T.ArrayType(T.StringType())),
    T.StructField("update_exception", T.BooleanType()),
    T.StructField("web", T.BooleanType()),
    T.StructField("essential", T.IntegerType()),
    T.StructField("recurrent", T.IntegerType()),
    T.StructField("product_service", T.IntegerType()),
])

RULES = T.StructType([T.StructField("rule_ord", T.IntegerType())] + RULE_FIELDS.fields)

GROUPS = T.StructType([
    T.StructField("grp", T.StringType()),
    T.StructField("grp_ord", T.IntegerType()),
    T.StructField("classification", T.StringType()),
])

# Copies are rows that agree on these; neither the file nor the booking date counts.
COPY_KEY = ["txn_date", "description", "amount", "owner", "std_description", "classification"]
