"""Tenant scoping: one factory for scoped tables, and a second check behind it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer import schemas


class NotFound(LookupError):
    """No such row, or one of another tenant: the two look alike."""


@dataclass(frozen=True)
class TenantScope:
    """Access to tables as one tenant; without a tenant every table is empty, and nothing fails."""

    tenant: str | int | None

    def table(self, df: DataFrame, column: str = "tenant_id") -> DataFrame:
        """Rows of this tenant. A plain equality, so that null on either side matches nothing and scans prune by it."""
        kind = df.schema[column].dataType
        return df.filter(F.col(column) == F.lit(self.tenant).cast(kind))

    def named(self, name: str, df: DataFrame) -> DataFrame:
        return self.table(df, schemas.SCOPED[name])

    def violations(self, df: DataFrame, column: str = "tenant_id") -> DataFrame:
        """Rows that this tenant may not write."""
        return df.filter(~F.coalesce(F.col(column) == F.lit(self.tenant), F.lit(False)))

    def require(self, df: DataFrame, key: str, value, column: str = "tenant_id") -> DataFrame:
        """The one row of a key, checked on its own; raises NotFound if it is missing or foreign."""
        found = df.filter(F.col(key) == value)
        rows = found.select(column).take(1)
        if not rows or self.tenant is None or rows[0][0] != self.tenant:
            raise NotFound(f"{key} {value}")
        return self.table(found, column)


def page_of(df: DataFrame, order: list, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of an ordered list; limits from 1 to 500."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1 to 500, offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    """The user of an address in any case; of several tenants' users the smallest id."""
    return users.filter(F.lower("email") == email.lower()).orderBy("id").limit(1)


def after_failure(users: DataFrame, limit: int = 5, minutes: int = 5, now=None) -> DataFrame:
    """Users after one more failed login: counted, and locked from the limit on."""
    now = F.current_timestamp() if now is None else now
    failed = F.col("failed_logins") + 1
    locked = F.when(failed >= limit, now + F.make_dt_interval(mins=F.lit(minutes))).otherwise(F.col("locked_until"))
    return users.withColumns({"failed_logins": failed, "locked_until": locked})


def after_success(users: DataFrame, new_hash: str | None = None) -> DataFrame:
    return users.withColumns({"failed_logins": F.lit(0), "locked_until": F.lit(None).cast("timestamp"), "password_hash": F.coalesce(F.lit(new_hash), F.col("password_hash"))})


def user_by_id(users: DataFrame, key) -> DataFrame:
    """The user of an id, if active; none otherwise."""
    return users.filter((F.col("id") == key) & (F.col("status") == "ACTIVE"))


def ordered_questions(questions: DataFrame, exam) -> DataFrame:
    """An exam's questions by position, then by number as text."""
    return questions.filter(F.col("exam_id") == exam).orderBy("position", F.col("number").cast("string"))


def downloads(booklets: DataFrame, exams: DataFrame, questions: DataFrame, version: str) -> DataFrame:
    """(booklet, exam, n_questions, status): a booklet with its exam; one of another layout version is refused, not redrawn."""
    counts = questions.groupBy(F.col("exam_id").alias("exam")).agg(F.count("*").alias("n_questions"))
    rows = booklets.select(F.col("id").alias("booklet"), F.col("exam_id").alias("exam"), "layout_version").join(exams.select(F.col("id").alias("exam"), F.lit(True).alias("found")), "exam", "left").join(counts, "exam", "left")
    status = F.when(F.col("found").isNull(), "NOT_FOUND").when(F.coalesce(F.col("layout_version") == version, F.lit(False)), "SERVED").otherwise("STALE_LAYOUT")
    return rows.select("booklet", "exam", F.coalesce("n_questions", F.lit(0).cast("long")).alias("n_questions"), status.alias("status"))


def reveal(identities: DataFrame, enrolments: DataFrame, actor: str) -> tuple[DataFrame, DataFrame]:
    """Names behind booklets, and the audit rows without which they may not be shown: one for each booklet revealed.

    identities (booklet_id, enrolment_id) meet enrolments (id, index_number, display_name); an identity without an enrolment has no
    name and is not revealed. Nothing else here joins the two.
    """
    names = enrolments.select(F.col("id").alias("enrolment_id"), "index_number", "display_name")
    shown = identities.select("booklet_id", "enrolment_id").join(names, "enrolment_id")
    audit = shown.select(F.lit("identity.reveal").alias("action"), F.lit(actor).alias("actor_id"), F.lit("booklet").alias("entity_type"), F.col("booklet_id").cast("string").alias("entity_id"))
    return shown.select("booklet_id", "index_number", "display_name"), audit


def refuse_unscoped(df: DataFrame, column: str = "tenant_id") -> DataFrame:
    """``df``, if the tenant policy can hold on it; raises where there is no tenant column, and on any row without a tenant."""
    if column not in df.columns:
        raise ValueError(f"no column {column} to scope by")
    return df.filter(F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} is null")).cast("boolean")).otherwise(F.lit(True)))


def key_violations(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set and has no parent."""
    return df.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def seal(value, key):
    """Encrypted identifiers (AES-GCM, trimmed first); two seals of one value differ."""
    return F.aes_encrypt(F.trim(value), key, F.lit("GCM"))


def unseal(value, key):
    return F.aes_decrypt(value, key, F.lit("GCM")).cast("string")


def in_batches(rows: DataFrame, request: str, order: str, most: int = 500) -> DataFrame:
    """``batch`` added: a request's rows in order, ``most`` to a batch. A request's count is bounded by what a form may ask for."""
    nth = F.row_number().over(W.partitionBy(request).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(nth / most))


def batch_audit(rows: DataFrame, request: str, order: str, action: str = "booklets.issue") -> DataFrame:
    """(request, batch, action, n, first_id, last_id): one audit row for each batch, whatever its size."""
    return rows.groupBy(request, "batch").agg(F.lit(action).alias("action"), F.count("*").alias("n"), F.min(order).alias("first_id"), F.max(order).alias("last_id"))
