"""Table contracts: keys, cursor, typed columns, domains and minimums."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 3
TECHNICAL = ("_batch_id", "_run_id", "_ingested_at", "_source_table", "_schema_version")


@dataclass(frozen=True)
class TableContract:
    """ddl: columns in order, NOT NULL where required. cursor: the timestamp column that keys complete."""

    name: str
    keys: tuple[str, ...]
    cursor: str
    ddl: str
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    minimums: dict[str, int] = field(default_factory=dict)
    references: dict[str, str] = field(default_factory=dict)
    append_only: bool = False
    version: int = SCHEMA_VERSION

    def __post_init__(self) -> None:
        names = {c.split()[0] for c in self.ddl.split(", ")}  # parsing needs a session, which may come later
        used = {*self.keys, self.cursor, *self.domains, *self.minimums, *self.references}
        if not self.keys or not used <= names:
            raise ValueError(f"contract {self.name} names unknown columns: {sorted(used - names)}")

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    def cursor_of(self) -> Column:
        """(timestamp, keys): structs compare field by field."""
        return F.struct(F.col(self.cursor), *[F.col(k) for k in self.keys])

    def check_columns(self, df: DataFrame) -> None:
        if df.columns != self.schema.names:
            raise ValueError(f"SCHEMA_MISMATCH {self.name}: {df.columns} instead of {self.schema.names}")


# The retail source's tables.
CONTRACTS = {
    c.name: c
    for c in (
        TableContract("customers", ("customer_id",), "created_at", "customer_id string NOT NULL, customer_unique_id string NOT NULL, customer_city string, customer_state string, created_at timestamp NOT NULL"),
        TableContract(
            "customer_subscriptions", ("subscription_id",), "updated_at",
            "subscription_id string NOT NULL, customer_unique_id string NOT NULL, subscription_status string NOT NULL, auto_renew_enabled boolean NOT NULL, subscription_started_at timestamp NOT NULL, "
            "current_period_started_at timestamp, current_period_ends_at timestamp, billing_due_at timestamp, next_payment_attempt_at timestamp, payment_failed_at timestamp, cancel_requested_at timestamp, "
            "ended_at timestamp, status_changed_at timestamp NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
            domains={"subscription_status": ("ACTIVE", "PAYMENT_FAILED", "CANCEL_REQUESTED", "CHURNED")},
        ),
        TableContract(
            "customer_membership_tiers", ("customer_unique_id",), "updated_at", "customer_unique_id string NOT NULL, membership_tier string NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
            domains={"membership_tier": ("BRONZE", "SILVER", "GOLD")},
        ),
        TableContract(
            "subscription_payments", ("payment_id",), "updated_at",
            "payment_id string NOT NULL, subscription_id string NOT NULL, billing_cycle_sequence int NOT NULL, attempt_sequence int NOT NULL, payment_status string NOT NULL, payment_at timestamp NOT NULL, "
            "payment_value decimal(14,2) NOT NULL, currency_code string NOT NULL, billing_period_start_at timestamp NOT NULL, billing_period_end_at timestamp NOT NULL, payment_method_type string, payment_provider string, "
            "provider_payment_id string, failure_code string, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
            domains={"payment_status": ("completed", "failed")}, minimums={"billing_cycle_sequence": 1, "attempt_sequence": 1, "payment_value": 0}, append_only=True,
        ),
        TableContract(
            "products", ("product_id",), "updated_at",
            "product_id string NOT NULL, product_category_name string, product_weight_g int, product_length_cm int, product_height_cm int, product_width_cm int, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
        ),
        TableContract("sellers", ("seller_id",), "updated_at", "seller_id string NOT NULL, seller_city string, seller_state string, created_at timestamp NOT NULL, updated_at timestamp NOT NULL"),
        TableContract(
            "orders", ("order_id",), "updated_at",
            "order_id string NOT NULL, customer_id string NOT NULL, order_status string NOT NULL, order_purchase_timestamp timestamp NOT NULL, order_approved_at timestamp, order_delivered_carrier_date timestamp, "
            "order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
            domains={"order_status": ("created", "approved", "processing", "invoiced", "shipped", "delivered", "canceled", "unavailable")},
        ),
        TableContract(
            "order_items", ("order_id", "order_item_id"), "created_at",
            "order_id string NOT NULL, order_item_id int NOT NULL, product_id string NOT NULL, seller_id string NOT NULL, shipping_limit_date timestamp NOT NULL, price decimal(14,2) NOT NULL, freight_value decimal(14,2) NOT NULL, created_at timestamp NOT NULL",
            minimums={"order_item_id": 1, "price": 0, "freight_value": 0}, references={"order_id": "orders", "product_id": "products", "seller_id": "sellers"}, append_only=True,
        ),
        TableContract(
            "order_payments", ("order_id", "payment_sequential"), "updated_at",
            "order_id string NOT NULL, payment_sequential int NOT NULL, payment_type string NOT NULL, payment_installments int, payment_value decimal(14,2) NOT NULL, payment_status string NOT NULL, payment_initiated_at timestamp, "
            "payment_completed_at timestamp, payment_failed_at timestamp, payment_refunded_at timestamp, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
            domains={"payment_status": ("pending", "completed", "failed", "refunded")}, minimums={"payment_sequential": 1, "payment_installments": 0, "payment_value": 0}, references={"order_id": "orders"},
        ),
    )
}

#: The events table as a source.
EVENTS = TableContract(
    "events", ("event_id",), "ts", "event_id bigint NOT NULL, ts timestamp_ntz NOT NULL, user_id bigint NOT NULL, event_type string NOT NULL, value double NOT NULL, props string",
    domains={"event_type": ("signup", "view", "click", "purchase", "error")}, minimums={"value": 0},
)
