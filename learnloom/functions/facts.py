"""Structured facts in question text: clock, money, fraction, route, odd-one-out.

Every parser is a column expression over prompt, choices and answer; null means no fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from learnloom import constants as K

# Text patterns of the question bank. BLANK is any Unicode white space.
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
HALF = r"^([0-9]+)じはん$"
QUARTER = r"^([0-9]+)じ(15|45)ふん$"
HOUR = r"^([0-9]+)じ$"
YEN = r"^([0-9]+)えん$"
MONEY_ITEM = rf"([0-9]+)えん(だま|さつ){BLANK}*([0-9]+)まい"
MONEY_CHANGE = (
    rf"([0-9]+)えん(?:の{BLANK}*[^。]+?)?{BLANK}*を{BLANK}*([0-9]+)えんで{BLANK}*(?:かいました|しはらいました)"
)
EQUAL_PARTS = r"([0-9]+)とうぶん"
FRACTION = rf"([0-9]+){BLANK}*/{BLANK}*([0-9]+)"
ROUTE_LENGTHS = r"^[0-9]+(\+[0-9]+)*$"
ROUTE_PREFIXES = ["みち", "ルート", "コース"]
ROUTE_SUFFIX = "みち"


def _number(text: Column, pattern: str, group: int) -> Column:
    """Captured digits as a number, null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("double")


def _js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def answer_text() -> Column:
    """The right choice; an empty one counts as missing."""
    return F.nullif(F.get("choices", F.col("answer_index")), F.lit(""))


def clock_fact(answer: Column) -> Column:
    text = _js_trim(answer)
    cases = [
        (_number(text, HALF, 1), F.lit(30)),
        (_number(text, QUARTER, 1), _number(text, QUARTER, 2).cast("int")),
        (_number(text, HOUR, 1), F.lit(0)),
    ]
    hour, minute = F.lit(None).cast("int"), F.lit(None).cast("int")
    for value, at in reversed(cases):
        ok = value.between(1, 12)
        hour = F.when(ok, value.cast("int")).otherwise(hour)
        minute = F.when(ok, at).otherwise(minute)
    tail = F.when(minute == 0, "じ").when(minute == 30, "じはん").otherwise(
        F.concat(F.lit("じ"), minute.cast("string"), F.lit("ふん"))
    )
    return F.when(
        hour.isNotNull(),
        F.struct(
            hour.alias("hour"), minute.alias("minute"), F.concat(hour.cast("string"), tail).alias("label")
        ),
    )


def money_items(prompt: Column) -> Column:
    """All (value, count, kind) mentions with a positive count."""
    mentions = F.regexp_extract_all(prompt, F.lit(MONEY_ITEM), F.lit(0))
    items = F.transform(
        mentions,
        lambda m: F.struct(
            F.regexp_extract(m, MONEY_ITEM, 1).cast("double").alias("value"),
            F.regexp_extract(m, MONEY_ITEM, 3).cast("double").alias("count"),
            F.when(F.regexp_extract(m, MONEY_ITEM, 2) == "さつ", "bill").otherwise("coin").alias("kind"),
        ),
    )
    return F.filter(items, lambda i: i["count"] > 0)


def money_fact(prompt: Column, answer: Column, skill: Column, items: Column) -> Column:
    paid_amount = _number(_js_trim(answer), YEN, 1)
    price, paid = _number(prompt, MONEY_CHANGE, 1), _number(prompt, MONEY_CHANGE, 2)
    nothing = F.lit(None).cast("double")

    def fact(mode, rows, total, price, paid):
        return F.struct(
            mode.alias("mode"), rows.alias("items"), total.alias("total"), price.alias("price"), paid.alias("paid")
        )

    change = fact(
        F.lit("change"),
        F.slice(items, 1, 0),
        F.coalesce(paid_amount, F.greatest(F.lit(0.0), paid - price)),
        price,
        paid,
    )
    summed = F.aggregate(items, F.lit(0.0), lambda acc, i: acc + i["value"] * i["count"])
    mode = F.when(skill == "money_value", "value").otherwise("sum")
    listed = fact(mode, items, F.coalesce(paid_amount, summed), nothing, nothing)
    return F.when(
        answer.isNotNull(),
        F.when(skill == "money_change", F.when(price.isNotNull() & paid.isNotNull(), change)).when(
            F.size(items) > 0, listed
        ),
    )


def fraction_fact(prompt: Column, answer: Column) -> Column:
    denominator = F.coalesce(_number(prompt, EQUAL_PARTS, 1), _number(answer, FRACTION, 2))
    numerator = F.coalesce(_number(answer, FRACTION, 1), F.lit(1.0))
    good = answer.isNotNull() & (denominator >= 2) & (numerator >= 1) & (numerator <= denominator)
    whole = lambda n: n.cast("bigint").cast("string")
    return F.when(
        good,
        F.struct(
            numerator.alias("numerator"),
            denominator.alias("denominator"),
            F.concat(whole(numerator), F.lit("/"), whole(denominator)).alias("label"),
        ),
    )


def route_key(name: Column) -> Column:
    """Name without blanks, known prefixes (each once, in order) and suffix."""
    key = F.regexp_replace(name, f"{BLANK}+", "")
    for prefix in ROUTE_PREFIXES:
        key = F.regexp_replace(key, f"^{prefix}", "")
    return F.regexp_replace(key, f"{ROUTE_SUFFIX}$", "")


def route_options(prompt: Column) -> Column:
    """Options "name a+b+c" of the first sentence, in order."""
    sentence = _js_trim(F.substring_index(prompt, "。", 1))
    chunks = F.transform(F.split(sentence, "、"), lambda c: _js_trim(c))

    def option(chunk):
        lengths = F.regexp_replace(_js_trim(F.substring_index(chunk, " ", -1)), "ほ", "")
        blanks = F.size(F.split(chunk, " ")) - 1
        name = _js_trim(F.array_join(F.slice(F.split(chunk, " "), F.lit(1), blanks), " "))
        return F.struct(
            name.alias("name"),
            F.when(
                lengths.rlike(ROUTE_LENGTHS), F.transform(F.split(lengths, r"\+"), lambda n: n.cast("double"))
            ).alias("segments"),
        )

    usable = F.filter(
        F.transform(F.filter(chunks, lambda c: F.contains(c, F.lit(" "))), option),
        lambda o: o.segments.isNotNull() & F.forall(o.segments, lambda n: n > 0),
    )
    return F.transform(
        usable,
        lambda o: F.struct(
            o["name"].alias("name"),
            o.segments.alias("segments"),
            F.aggregate(o.segments, F.lit(0.0), lambda a, n: a + n).alias("distance"),
        ),
    )


def route_fact(answer: Column, options: Column) -> Column:
    named = F.get(F.filter(options, lambda o: route_key(o["name"]) == route_key(answer)), F.lit(0)).getField("name")
    by_distance = F.array_sort(
        F.transform(options, lambda o, i: F.struct(o.distance.alias("distance"), i.alias("at"), o["name"].alias("name")))
    )
    shortest = F.get(by_distance, F.lit(0)).getField("name")
    return F.when(
        answer.isNotNull() & (F.size(options) >= 2),
        F.struct(options.alias("options"), F.coalesce(named, shortest).alias("best_route")),
    )


def odd_one_fact(choices: Column) -> Column:
    items = F.filter(F.transform(choices, lambda c: _js_trim(c)), lambda c: F.length(c) > 0)
    return F.when(F.size(items) == 3, F.struct(items.alias("items")))


def with_facts(questions: DataFrame) -> DataFrame:
    """Add one nullable struct per fact type and ``kind``; subject and skill decide which."""
    subject, skill, prompt = F.col("subject"), F.col("skill_id"), F.col("prompt")
    answer = F.col("_answer")
    life = subject == "life"
    clock, money = life & skill.startswith("clock_"), life & skill.startswith("money_")
    facts = {
        "clock": F.when(clock, clock_fact(answer)),
        "money": F.when(money, money_fact(prompt, answer, skill, F.col("_items"))),
        "fraction": F.when(~clock & ~money & (skill == "fractions_basic"), fraction_fact(prompt, answer)),
        "route": F.when(skill == "route_optimization", route_fact(answer, F.col("_options"))),
        "odd_one_out": F.when(skill == "odd_one_out", odd_one_fact(F.col("choices"))),
    }
    # Parsed lists are columns of their own, so each text is parsed once.
    parsed = questions.withColumns(
        {
            "_answer": answer_text(),
            "_items": F.when(money, money_items(prompt)),
            "_options": F.when(skill == "route_optimization", route_options(prompt)),
        }
    )
    out = parsed.withColumns(facts).drop("_answer", "_items", "_options")
    kind = F.coalesce(*[F.when(F.col(name).isNotNull(), F.lit(name)) for name in facts])
    return out.withColumn("kind", kind)


def decompose(amount: Column) -> Column:
    """(value, count, kind) of an amount in denominations, largest first. Each denomination
    divides the one before, so its count is a remainder, not a running balance."""
    whole = F.greatest(F.lit(0), F.floor(amount))
    items, larger = [], None
    for value in K.DENOMINATIONS:
        rest = whole if larger is None else F.pmod(whole, F.lit(larger).cast("bigint"))
        items.append(
            F.struct(
                F.lit(value).alias("value"),
                F.floor(rest / value).alias("count"),
                F.lit("bill" if value >= K.BILL_FROM else "coin").alias("kind"),
            )
        )
        larger = value
    return F.filter(F.array(*items), lambda i: i["count"] > 0)
