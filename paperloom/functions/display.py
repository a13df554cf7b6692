"""What readers see: numbers, times, places in a document and links, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import values as V

#: Signs of currencies; other codes stand before the amount as they are.
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "¥", "AUD": "A$", "CAD": "C$", "CHF": "CHF ", "INR": "₹"}
#: Words in a field's name that make it an amount of money.
MONEY_WORDS = ["total", "subtotal", "sub_total", "amount", "price", "unit_price", "balance", "paid", "fee", "cost", "charge", "tax", "vat", "gst"]


def duration(ms: Column) -> Column:
    return F.when(ms.isNull(), "—").when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit(" ms"))).otherwise(F.format_string("%.2f s", ms / 1000))


def percent(share: Column) -> Column:
    return F.when(share.isNull(), "—").otherwise(F.concat(F.floor(share * 100 + 0.5).cast("long").cast("string"), F.lit("%")))


def day(iso: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), "MMM d, yyyy"), F.lit(""))


def is_money(name: Column) -> Column:
    return F.lower(name).rlike("|".join(MONEY_WORDS))


def money(amount: Column, currency: Column) -> Column:
    code = F.upper(F.trim(currency))
    sign = F.try_element_at(F.create_map(*(F.lit(x) for pair in SIGNS.items() for x in pair)), code)
    shown = F.format_number(amount, 2)
    return F.when(F.coalesce(currency, F.lit("")) == "", V.as_text(V.Number(amount))).otherwise(F.concat(F.coalesce(sign, F.concat(code, F.lit(" "))), shown))


def match_key(s: Column) -> Column:
    """Text for finding a snippet in a block: case, table marks and stray punctuation don't count."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(s), "-{2,}", " "), r"\|", " ")
    return V.collapse(F.regexp_replace(spaced, r"[^\w .,/$%@\-]", ""))


def a1(sheet: Column, col: Column, row: Column) -> Column:
    cell = F.concat(V.column_letters(col), (row + 1).cast("string"))
    return F.when(F.coalesce(sheet, F.lit("")) == "", cell).otherwise(F.concat(sheet, F.lit("!"), cell))


def scaled(box: Column, scale: Column) -> Column:
    """A box (x0, y0, x1, y1) as x, y, width, height at another scale."""
    return F.struct((box[0] * scale).alias("x"), (box[1] * scale).alias("y"), ((box[2] - box[0]) * scale).alias("width"), ((box[3] - box[1]) * scale).alias("height"))


def region_key(page: Column, box: Column) -> Column:
    return F.concat_ws(":", page, *(F.round(box[i]).cast("long") for i in range(4)))


def route(link: Column) -> Column:
    """(view, id, tab, member) of a link's hash part; what isn't known is the home view."""
    bare = F.regexp_replace(link, "^#?/?", "")
    parts = F.filter(F.split(F.substring_index(bare, "?", 1), "/"), lambda x: x != "")
    head, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    asked = F.str_to_map(F.when(F.contains(bare, F.lit("?")), F.substring_index(bare, "?", -1)).otherwise(""), F.lit("&"), F.lit("="))
    view = (
        F.when((head == "documents") & second.isNotNull(), "document").when((head == "cases") & (F.coalesce(second, F.lit("new")) == "new"), "cases")
        .when(head == "cases", "case").when(head.isin("admin", "templates"), head).otherwise("home")
    )
    is_item = view.isin("document", "case", "admin", "templates")
    return F.struct(view.alias("view"), F.when(is_item, F.try_url_decode(second)).alias("id"), F.when(view == "document", F.try_element_at(asked, F.lit("tab"))).alias("tab"), F.when(view == "case", F.try_element_at(asked, F.lit("member"))).alias("member"))
