"""Invoices, receipts and statements as tables of exact decimals, and their reconciliation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,6)"


def money(c: Column, places: int = 2) -> Column:
    """Rounded half up."""
    return F.round(c.cast("decimal(38,10)"), places).cast(MONEY)


def line_totals(lines: DataFrame, quantity: str = "quantity", price: str = "unit_price") -> DataFrame:
    return lines.withColumn("line_total", money(F.col(quantity).cast("decimal(18,6)") * F.col(price).cast("decimal(18,6)")))


#: Most rows, on average, in a task that sums lines, and fewest before there are more tasks than needed.
LINES, FEWEST = 500_000, 20_000


def parts(lines: DataFrame) -> int:
    """In how many parts ``lines`` are summed: the rows of a part do not grow with the table."""
    n = lines.count()
    return max(1, min(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // FEWEST), -(-n // LINES))


def tax_summary(lines: DataFrame, doc: str, inclusive: bool = False) -> DataFrame:
    """doc, tax_label, tax_rate, taxable, tax: summed by rate first and rounded once.

    There are nearly as many groups as lines, so sums by split would hold a split in memory. Lines are dealt by document and
    split instead, in parts of bounded size, and their sums by document: one of very many lines is summed in many tasks.
    """
    n = parts(lines)
    rate = F.col("tax_rate").cast("decimal(8,6)")
    picked = lines.select(doc, "tax_label", rate.alias("tax_rate"), F.col("line_total").alias("gross"), F.spark_partition_id().alias("__split"))
    some = picked.repartition(n, doc, "__split").groupBy(doc, "tax_label", "tax_rate", "__split").agg(F.sum("gross").alias("gross"))
    sums = some.repartition(n, doc).groupBy(doc, "tax_label", "tax_rate").agg(F.sum("gross").alias("gross"))
    g, r = F.col("gross"), F.col("tax_rate")
    tax = money(g - g / (F.lit(1) + r)) if inclusive else money(g * r)
    return sums.select(doc, "tax_label", "tax_rate", (g - tax if inclusive else g).cast(MONEY).alias("taxable"), tax.alias("tax"))


def invoices(lines: DataFrame, doc: str, inclusive: bool = False) -> DataFrame:
    """doc, subtotal, tax_total, total."""
    return tax_summary(lines, doc, inclusive).groupBy(doc).agg(F.sum("taxable").cast(MONEY).alias("subtotal"), F.sum("tax").cast(MONEY).alias("tax_total")).withColumn("total", (F.col("subtotal") + F.col("tax_total")).cast(MONEY))


def reconcile(heads: DataFrame, lines: DataFrame, doc: str, inclusive: bool = False) -> DataFrame:
    """doc, problem: stated totals that the lines do not give."""
    made = invoices(lines, doc, inclusive).select(doc, *[F.col(c).alias(f"__{c}") for c in ("subtotal", "tax_total", "total")])
    both = heads.join(made, doc, "left")
    problems = F.filter(F.array(*[F.when(~F.col(c).cast(MONEY).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in ("subtotal", "tax_total", "total")]), lambda p: p.isNotNull())
    return both.select(doc, F.explode(problems).alias("problem"))


def receipts(totals: DataFrame, total: str, step: int = 5) -> DataFrame:
    """``totals`` with ``tendered``, the total rounded up to a step, and ``change``."""
    up = (F.ceil(F.col(total).cast("double") / step) * step).cast(MONEY)
    return totals.withColumn("tendered", up).withColumn("change", (F.col("tendered") - F.col(total)).cast(MONEY))


def statements(transactions: DataFrame, account: str, seq: str, opening: float = 0.0) -> DataFrame:
    """Transactions (debit, credit) with the balance after each."""
    w = Window.partitionBy(account).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    moved = F.coalesce(F.col("credit").cast(MONEY), F.lit(0).cast(MONEY)) - F.coalesce(F.col("debit").cast(MONEY), F.lit(0).cast(MONEY))
    return transactions.withColumn("balance", (F.lit(opening).cast(MONEY) + F.sum(moved).over(w)).cast(MONEY))


def summary(statement: DataFrame, account: str, seq: str) -> DataFrame:
    """account, opening, closing, debits, credits, rows of the rows given."""
    moved = F.coalesce(F.col("credit").cast(MONEY), F.lit(0).cast(MONEY)) - F.coalesce(F.col("debit").cast(MONEY), F.lit(0).cast(MONEY))
    return statement.groupBy(account).agg(
        F.min_by((F.col("balance") - moved).cast(MONEY), F.col(seq)).alias("opening"), F.max_by("balance", seq).alias("closing"),
        F.coalesce(F.sum(F.col("debit").cast(MONEY)), F.lit(0)).cast(MONEY).alias("debits"), F.coalesce(F.sum(F.col("credit").cast(MONEY)), F.lit(0)).cast(MONEY).alias("credits"), F.count(F.lit(1)).alias("rows"),
    )


@dataclass
class StatementFilter:
    """What is asked of a statement; ``unparsed`` are the words that meant nothing."""

    days: int | None = None
    amount_min: Decimal | None = None
    amount_max: Decimal | None = None
    balance_min: Decimal | None = None
    balance_max: Decimal | None = None
    kind: str | None = None  # debit or credit
    category: str | None = None
    merchant: str | None = None
    unparsed: list[str] = field(default_factory=list)

    def condition(self, as_of: Column, date: str = "date") -> Column:
        """As a filter over date, debit, credit, balance, category and description."""
        amount = F.greatest(F.coalesce(F.col("debit"), F.lit(0)), F.coalesce(F.col("credit"), F.lit(0)))
        parts = [F.lit(True)]
        if self.days is not None:
            parts.append(F.col(date) >= F.date_sub(as_of, self.days))
        for low, high, c in ((self.amount_min, self.amount_max, amount), (self.balance_min, self.balance_max, F.col("balance"))):
            parts += [c >= F.lit(low)] if low is not None else []
            parts += [c <= F.lit(high)] if high is not None else []
        if self.kind:
            parts.append(F.coalesce(F.col(self.kind), F.lit(0)) > 0)
        if self.category:
            parts.append(F.lower("category") == self.category.lower())
        if self.merchant:
            parts.append(F.contains(F.lower("description"), F.lit(self.merchant.lower())))
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


_AMOUNT = r"[$€£₹]?\s*(\d[\d,]*(?:\.\d+)?)\s*([km]?)\b"
_UNITS = {"day": 1, "week": 7, "month": 30, "year": 365}
_IDLE = {"show", "me", "all", "the", "my", "transactions", "transaction", "payments", "payment", "with", "of", "and", "in", "for", "a", "an", "that", "are", "were", "is", "entries", "please", "only"}


def _amount(number: str, suffix: str) -> Decimal:
    return Decimal(number.replace(",", "")) * {"": 1, "k": 1_000, "m": 1_000_000}[suffix.lower()]


def parse_statement_query(query: str) -> StatementFilter:
    """Plain words as a filter: "debits over 5k in the last 3 months at Acme". Strict bounds move by one cent."""
    out, rest = StatementFilter(), f" {query.lower().strip()} "

    def take(pattern: str):
        nonlocal rest
        if m := re.search(pattern, rest):
            rest = f"{rest[: m.start()]} {rest[m.end() :]}"
        return m

    if m := take(r"\b(?:last|past|previous)\s+(\d+)?\s*(day|week|month|year)s?\b"):
        out.days = int(m[1] or 1) * _UNITS[m[2]]
    if m := take(rf"\bbetween\s+{_AMOUNT}\s+and\s+{_AMOUNT}"):
        out.amount_min, out.amount_max = _amount(m[1], m[2]), _amount(m[3], m[4])
    cent = Decimal("0.01")
    for words, low, strict in ((r"at least|minimum|min|>=", True, False), (r"at most|maximum|max|up to|<=", False, False), (r"over|above|more than|greater than|>", True, True), (r"under|below|less than|<", False, True)):
        for subject in ("balance", "amount"):
            head = r"\bbalance\s+(?:is\s+)?" if subject == "balance" else r"(?:\b|(?<=\s))"
            if m := take(rf"{head}(?:{words})\s*{_AMOUNT}"):
                value = _amount(m[1], m[2]) + (cent if low and strict else -cent if strict else 0)
                setattr(out, f"{subject}_{'min' if low else 'max'}", value)
    if m := take(r"\b(debits?|withdrawals?|spending|spent|credits?|deposits?|income)\b"):
        out.kind = "debit" if m[1][0] in "dws" and not m[1].startswith("deposit") else "credit"
    if m := take(r"\bcategory\s+(\w+)"):
        out.category = m[1]
    if m := take(r"\b(?:at|from|to|merchant)\s+([a-z][\w&'-]*)"):
        out.merchant = m[1]
    out.unparsed = [w for w in re.findall(r"[\w$€£]+", rest) if w not in _IDLE]
    return out
