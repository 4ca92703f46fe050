"""Declaration extraction from printed lines.

One shuffle brings each line together with its neighbours (in blocks, so a long label
spreads out). Every stage of every field is then evaluated on that one row, and the
best hit per scan and field is an aggregate that combines before its shuffle.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packaudit import dims
from packaudit.functions import fuzzy, quantity, skew, text as tx

QUANTITY = ("struct<raw:string,value:double,unit:string,multiplier:int,base_value:double,base_unit:string,"
            "kind:string,ocr_recovered:boolean>")
SEGMENT = "struct<line_no:int,from:int,to:int>"
HIT = (f"struct<field:string,stage:string,match_confidence:double,line_no:int,raw_text:string,value_text:string,"
       f"price:double,quantity:{QUANTITY},mfg:struct<month:int,year:int>,"
       f"contact:struct<email:string,phone:string>,segments:array<{SEGMENT}>,note:string>")

WRAP_GAP, WRAP_SPAN = 1.6, 2


# -------------------------------------------------------------------- line context
def _around(span: int):
    """Texts of the lines up to ``span`` before and after, joined by spaces; each is read at its place, no frame is collected."""
    return lambda w: F.concat_ws(" ", *[F.lead("text", i).over(w) if i else F.col("text")
                                        for i in range(-span, span + 1)])


def line_context(lines: DataFrame, block: int = 4096) -> DataFrame:
    """Each line with its continuation window, neighbourhoods and what follows.

    Input: scan_id, line_no (dense from 0), text, x, y, w, h. Adds ``norm``; the window
    as ``wtext``/``wnorm`` with ``w1``, ``w2`` telling how many lines it took in;
    ``near2`` and ``near3``; and ``below``, the first slash price in the next six lines.
    """
    base = lines.select("scan_id", "line_no", "text", "x", "y", "w", "h").withColumn(
        "norm", tx.normalize_key("text"))
    base = base.withColumn("slash", slash_amount(F.col("text")))
    line = F.struct("text", "norm", "x", "y", "w", "h")
    slash_line = F.when(F.col("slash").isNotNull(), F.struct(
        (F.col("line_no")).alias("line_no"), F.col("text").alias("text"), F.col("slash").alias("slash")))

    ctx = skew.in_blocks(base, ["scan_id"], "line_no", before=3, after=dims.LEGEND_LOOKAHEAD, block=block, columns={
        "_n1": lambda w: F.lead(line, 1).over(w),
        "_n2": lambda w: F.lead(line, 2).over(w),
        "near2": _around(2), "near3": _around(3),
        "below": lambda w: F.coalesce(*[F.lead(slash_line, i).over(w) for i in range(1, dims.LEGEND_LOOKAHEAD + 1)]),
    })

    def follows(n: str, bottom: Column, height: Column) -> Column:
        nxt = F.col(n)
        near = nxt["y"] - bottom <= WRAP_GAP * F.greatest(height, nxt["h"])
        beside = (nxt["x"] <= F.col("x") + F.col("w")) & (nxt["x"] + nxt["w"] >= F.col("x"))
        return nxt.isNotNull() & near & beside

    ctx = ctx.withColumn("w1", follows("_n1", F.col("y") + F.col("h"), F.col("h")))
    ctx = ctx.withColumn("w2", F.col("w1") & follows(
        "_n2", F.col("_n1.y") + F.col("_n1.h"), F.col("_n1.h")))
    part = [(F.col("w1"), "_n1"), (F.col("w2"), "_n2")]
    return ctx.select(
        "scan_id", "line_no", "text", "norm", "x", "y", "w", "h", "slash", "near2", "near3", "below",
        F.concat_ws(" ", "text", *[F.when(c, F.col(n)["text"]) for c, n in part]).alias("wtext"),
        F.concat_ws("", "norm", *[F.when(c, F.col(n)["norm"]) for c, n in part]).alias("wnorm"),
        F.length("text").alias("len0"),
        *[F.when(c, F.length(F.col(n)["text"])).alias(f"len{i + 1}") for i, (c, n) in enumerate(part)])


def neighbourhood(lines: DataFrame, span: int) -> DataFrame:
    """Line text joined with ``span`` lines either side (F2)."""
    return skew.in_blocks(lines, ["scan_id"], "line_no", span, span, {"around": _around(span)})


# ----------------------------------------------------------------- phrase positions
def _find(norm: Column, phrase: str) -> Column:
    """Position from 0 of the first occurrence, null when absent.

    Whether a line holds a phrase is a search over bytes; only lines that do pay for the search that counts characters.
    """
    return F.when(norm.contains(phrase), F.instr(norm, F.lit(phrase)) - 1)


def exact_key_end(norm: Column, first_len: Column, field: str) -> Column:
    """End of the first listed key that starts on the window's own line.

    A key that begins with an earlier one never decides. The position stands below the search over bytes, not beside it: what a condition
    shares with its result is computed for every row.
    """
    ends = []
    phrases = dims.KEY_PHRASES[field]
    for i, phrase in enumerate(phrases):
        if any(phrase.startswith(p) for p in phrases[:i]):
            continue
        at = F.instr(norm, F.lit(phrase)) - 1
        ends.append((phrase, F.when(norm.contains(phrase), F.when(at < first_len, at + len(phrase)))))
    # Most lines hold none of the few parts that the keys have in common, and are not searched for every key.
    return F.when(holds_any(norm, tx.common_parts([p for p, _ in ends])), F.coalesce(*[e for _, e in ends]))


def holds_any(norm: Column, parts: list[str]) -> Column:
    return reduce(operator.or_, [norm.contains(p) for p in parts])


def first_negative(norm: Column, field: str) -> Column:
    """Position of the first rival phrase, null when there is none."""
    found = [_find(norm, p) for p in dims.NEGATIVE_PHRASES[field]]
    found += [F.when(norm.endswith(p), F.length(norm) - len(p)) for p in dims.NEGATIVE_TAIL.get(field, [])]
    return F.when(may_rival(norm, field), F.least(*found))


def may_rival(norm: Column, field: str) -> Column:
    """Does the text hold any of the few parts that the rival phrases of a field have in common?"""
    return holds_any(norm, tx.common_parts(dims.NEGATIVE_PHRASES[field] + dims.NEGATIVE_TAIL.get(field, [])))


def negative_cut(norm: Column, key_end: Column, field: str) -> Column:
    """struct<blocked,cut>: a rival before the key's end blocks, one after it cuts."""
    judged = tx.let(first_negative(norm, field), lambda at: F.struct(
        F.coalesce(at < key_end, F.lit(False)).alias("blocked"),
        F.when(at >= key_end, at).alias("cut")))
    return F.when(may_rival(norm, field), judged).otherwise(
        F.struct(F.lit(False).alias("blocked"), F.lit(None).cast("int").alias("cut")))


def slash_amount(text: Column) -> Column:
    """struct<val,pos> of the first ``545/-`` amount that is not a unit rate (F8)."""
    hit = F.regexp_extract(text, dims.SLASH_AMOUNT, 0)
    value = F.regexp_extract(text, dims.SLASH_AMOUNT, 1)
    at = F.regexp_instr(text, F.lit(dims.SLASH_AMOUNT)) - 1
    return F.when(text.contains("/"), F.when((hit != "") & ~hit.rlike(dims.UNIT_RATE), F.struct(
        value.alias("val"), (at + F.instr(hit, value) - 1).alias("pos"))))


def has_tax_phrase(norm: Column) -> Column:
    """The "inclusive of all taxes" statement in normalised text."""
    return norm.rlike("|".join(dims.TAX_PHRASES))


# -------------------------------------------------------------------- key matching
def match_keys(ctx: DataFrame, use_fuzzy: bool = True, fields: list[str] | None = None) -> DataFrame:
    """Add ``key_<field>``: struct<conf,end> of the key on each line, null without one.

    Only lines without an exact key that pass a built-in filter reach the fuzzy test; with ``fields``, it looks for
    keys of these only.
    """
    wanted = [f for f in fuzzy.FUZZY_FIELDS if fields is None or f in fields]
    first = F.length("norm")
    ends = {f: exact_key_end(F.col("wnorm"), first, f) for f in dims.KEY_PHRASES}
    df = ctx.withColumns({f"_e_{f}": e for f, e in ends.items()})
    date = quantity.parse_month_year(F.col("text"))
    df = df.withColumn("bare_date", F.when(first_negative(F.col("norm"), "mfg_date").isNull(), date))
    if use_fuzzy:
        maybe = F.lit(False)
        for f in wanted:
            maybe = maybe | (F.col(f"_e_{f}").isNull() & fuzzy.may_contain(F.col("norm"), dims.FUZZY_PHRASES[f]))
        head = F.when(F.col("bare_date").isNotNull() & (F.col("bare_date.pos") > 0),
                      tx.normalize_key(F.substring(F.col("text"), F.lit(1), F.col("bare_date.pos"))))
        near_key = F.coalesce(fuzzy.near_miss(head), F.lit(False)) if "mfg_date" in wanted else F.lit(False)
        df = df.withColumn("_fz", fuzzy.fuzzy_fields(F.when(maybe, F.col("norm"))))
    else:
        near_key = F.lit(False)
        df = df.withColumn("_fz", F.lit(0))
    out = {}
    for f in dims.KEY_PHRASES:
        exact = F.when(F.col(f"_e_{f}").isNotNull(), F.struct(
            F.lit(dims.CONF_EXACT).alias("conf"), F.col(f"_e_{f}").alias("end")))
        if f in fuzzy.FUZZY_FIELDS:
            bit = 1 << fuzzy.FUZZY_FIELDS.index(f)
            near = F.when(F.col("_fz").bitwiseAND(bit) != 0, F.struct(
                F.lit(dims.CONF_FUZZY).alias("conf"), F.lit(0).alias("end")))
            exact = F.coalesce(exact, near)
        out[f"key_{f}"] = exact
    return (df.withColumns({**out, "near_key": near_key})
            .drop("_fz", *[f"_e_{f}" for f in dims.KEY_PHRASES]))


# ------------------------------------------------------------------------ hits
def _window_segments(a: Column, b: Column) -> Column:
    """The char span [a, b) of the window as spans of its lines."""
    parts, offset = [], F.lit(0)
    for i in range(WRAP_SPAN + 1):
        length = F.col(f"len{i}")
        lo, hi = F.greatest(a - offset, F.lit(0)), F.least(b - offset, length)
        parts.append(F.when(lo < hi, F.struct(
            (F.col("line_no") + i).cast("int").alias("line_no"), lo.cast("int").alias("from"),
            hi.cast("int").alias("to"))))
        offset = offset + F.coalesce(length, F.lit(0)) + 1
    return F.array_compact(F.array(*parts))


def _line_segment(line_no: Column, a: Column, b: Column) -> Column:
    return F.array(F.struct(line_no.cast("int").alias("line_no"), a.cast("int").alias("from"),
                            b.cast("int").alias("to")))


def _hit(when: Column, field: str, stage: str, conf: Column, raw: Column, value: Column, segments: Column,
         note: Column, line_no: Column | None = None, price: Column | None = None, qty: Column | None = None,
         mfg: Column | None = None, contact: Column | None = None) -> Column:
    def typed(c: Column | None, ddl: str) -> Column:
        return (F.lit(None) if c is None else c).cast(ddl)
    return F.when(when, F.struct(
        F.lit(field).alias("field"), F.lit(stage).alias("stage"), conf.cast("double").alias("match_confidence"),
        (F.col("line_no") if line_no is None else line_no).cast("int").alias("line_no"), raw.alias("raw_text"),
        value.alias("value_text"), typed(price, "double").alias("price"), typed(qty, QUANTITY).alias("quantity"),
        typed(mfg, "struct<month:int,year:int>").alias("mfg"),
        typed(contact, "struct<email:string,phone:string>").alias("contact"),
        segments.cast(f"array<{SEGMENT}>").alias("segments"), note.alias("note")))


def _raw_pos(pos: Column) -> Column:
    """Raw position of normalised position ``pos`` of the window (only where needed)."""
    return F.get(tx.norm_positions(F.col("wtext")), pos)


def mrp_keyed(df: DataFrame) -> Column:
    """First amount after a price key, re-read from the raw text."""
    key, cut = F.col("key_mrp"), negative_cut(F.col("wnorm"), F.col("key_mrp.end"), "mrp")
    none = F.lit(None).cast("string")

    def located(c: Column) -> Column:
        size = F.coalesce(c["cut"], F.length("wnorm")) - key["end"]
        region = F.substring(F.col("wnorm"), key["end"] + 1, F.greatest(size, F.lit(0)))
        return F.when(~c["blocked"] & region.rlike(r"\d"), F.struct(
            (key["end"] + F.regexp_instr(region, F.lit(dims.KEYED_AMOUNT)) - 1
             + F.length(F.regexp_extract(region, dims.KEYED_AMOUNT, 1))).alias("pos"),
            F.regexp_extract(region, dims.KEYED_AMOUNT, 2).alias("norm_val")))

    def read(at: Column) -> Column:
        return tx.let(_raw_pos(at["pos"]), lambda a: tx.let(
            F.coalesce(F.nullif(F.regexp_extract(F.substring(F.col("wtext"), a + 1, F.lit(12)), dims.RAW_AMOUNT, 0),
                                F.lit("")), at["norm_val"]),
            lambda v: _hit(v.isNotNull(), "mrp", "keyed", key["conf"], F.col("wtext"), v,
                           _window_segments(a, a + F.length(v)), tax_note(),
                           price=quantity.decimal_text(v))))

    def tax_note() -> Column:
        stated = has_tax_phrase(F.col("wnorm")) | has_tax_phrase(tx.normalize_key(F.col("near2")))
        return F.when(stated, none).otherwise("'inclusive of all taxes' not found near the price")

    return F.when(key.isNotNull(), tx.let(tx.let(cut, located), lambda at: F.when(at.isNotNull(), read(at))))


def mrp_currency() -> Column:
    """A bare currency amount that starts on the line."""
    w = F.col("wtext")
    hit, val = F.regexp_extract(w, dims.CURRENCY_AMOUNT, 0), F.regexp_extract(w, dims.CURRENCY_AMOUNT, 1)
    at = F.regexp_instr(w, F.lit(dims.CURRENCY_AMOUNT)) - 1
    end = at + F.length(hit)
    # The currency's letters stand side by side in the normalised text too; few lines hold them and have no rival.
    maybe = holds_any(F.col("wnorm"), ["RS", "INR", "R5"]) & first_negative(F.col("norm"), "mrp").isNull()
    ok = F.when(maybe, F.when(hit != "", at < F.col("len0")))
    return _hit(ok, "mrp", "currency", F.lit(dims.CONF_CURRENCY), w, val,
                _window_segments(end - F.length(val), end),
                F.lit("currency amount without a price key; verify"), price=quantity.decimal_text(val))


def mrp_slash() -> Column:
    """An amount in ``545/-`` notation (F8)."""
    s = F.col("slash")
    ok = s.isNotNull() & first_negative(F.col("norm"), "mrp").isNull()
    return _hit(ok, "mrp", "slash", F.lit(dims.CONF_SLASH), F.col("text"), s["val"],
                _line_segment(F.col("line_no"), s["pos"], s["pos"] + F.length(s["val"])),
                F.lit("amount in '/-' notation without a price key; verify"),
                price=quantity.decimal_text(s["val"]))


def mrp_legend() -> Column:
    """A key line that points below, priced in the next six lines.

    ``line_no`` of the hit is the price's line; the legend line decides the order.
    """
    b = F.col("below")
    legend = (F.col("norm").rlike("|".join(dims.KEY_PHRASES["mrp"]))
              & F.col("norm").rlike("|".join(dims.LEGEND_MARKERS)))
    return _hit(b.isNotNull() & legend, "mrp", "legend", F.lit(dims.CONF_LEGEND), b["text"], b["slash"]["val"],
                _line_segment(b["line_no"], b["slash"]["pos"], b["slash"]["pos"] + F.length(b["slash"]["val"])),
                F.lit("key points elsewhere; price read below it; verify"), line_no=b["line_no"],
                price=quantity.decimal_text(b["slash"]["val"]))


def net_quantity() -> Column:
    """Quantity in a keyed window, or bare on a line that is no price and no dimension."""
    key = F.col("key_net_quantity")
    ok = key.isNotNull()
    rival = F.coalesce(first_negative(F.col("norm"), "mrp"), first_negative(F.col("norm"), "net_quantity"))
    where = F.when(ok, F.col("wtext")).otherwise(F.col("text"))
    qty = F.when(ok | rival.isNull(), quantity.parse_net_quantity(where, ok))

    def read(q: Column) -> Column:
        start = F.instr(where, q["raw"]) - 1 + F.regexp_instr(q["raw"], F.lit(r"\d{1,6}(?:[.,]\d{1,3})?")) - 1
        end = start + F.length(F.regexp_extract(q["raw"], r"\d{1,6}(?:[.,]\d{1,3})?", 0))
        note = (F.when(q["ocr_recovered"], "unit repaired from a likely misreading; verify")
                .when(~ok, "quantity without a quantity key"))
        return _hit(q.isNotNull(), "net_quantity", "keyed", F.coalesce(key["conf"], F.lit(dims.CONF_UNKEYED)),
                    where, q["raw"], _window_segments(start, end), note, qty=q)

    return tx.let(qty, read)


def mfg_keyed(strict_compat: bool = False) -> Column:
    """Date after a manufacture key, stopping at a rival date."""
    key = F.col("key_mfg_date")

    def read(c: Column) -> Column:
        pos = tx.norm_positions(F.col("wtext"))
        span = F.when(~c["blocked"], F.struct(
            F.coalesce(F.get(pos, key["end"]), F.lit(0)).alias("start"),
            F.coalesce(F.nullif(F.get(pos, c["cut"]), F.lit(0)), F.length("wtext")).alias("stop")))
        return tx.let(span, lambda s: tx.let(
            quantity.parse_month_year(F.substring(F.col("wtext"), s["start"] + 1,
                                                  F.greatest(s["stop"] - s["start"], F.lit(0))), strict_compat),
            lambda d: _hit(d.isNotNull(), "mfg_date", "keyed", key["conf"], F.col("wtext"), d["text"],
                           _window_segments(s["start"] + d["pos"], s["start"] + d["pos"] + F.length(d["text"])),
                           F.lit(None).cast("string"), mfg=F.struct(d["month"], d["year"]))))

    return F.when(key.isNotNull(), tx.let(negative_cut(F.col("wnorm"), key["end"], "mfg_date"), read))


def mfg_bare() -> Column:
    """A date on a line of no rival; better when a garbled key precedes it."""
    d, near = F.col("bare_date"), F.col("near_key")
    return _hit(d.isNotNull(), "mfg_date", "bare",
                F.when(near, F.lit(dims.CONF_NEAR_MISS)).otherwise(F.lit(dims.CONF_BARE_DATE)), F.col("text"),
                d["text"], _line_segment(F.col("line_no"), d["pos"], d["pos"] + F.length(d["text"])),
                F.when(near, "key read through a recognition error").otherwise("date without a key; verify"),
                mfg=F.struct(d["month"], d["year"]))


def manufacturer() -> Column:
    """A maker key with its surroundings as the address."""
    key, addr = F.col("key_manufacturer"), F.col("near3")
    has_address = addr.rlike(dims.PIN_CODE) | (F.length(addr) > 60)
    return _hit(key.isNotNull(), "manufacturer", "keyed", key["conf"], addr, F.trim(addr),
                _line_segment(F.col("line_no"), F.lit(0), F.col("len0")),
                F.when(~has_address, "maker key without an address"))


def consumer_care() -> Column:
    """A care key, or contact data nearby (F16)."""
    key, near = F.col("key_consumer_care"), F.col("near3")
    # A search over bytes, or for ten digits, leaves the long patterns to the few lines that may match; without ten digits only a toll-free number does.
    email = F.when(near.contains("@"), F.regexp_extract(near, dims.EMAIL, 0))
    phone = F.when(near.rlike(r"[6-9]\d{9}"), F.regexp_extract(near, dims.PHONE, 0)).when(
        near.contains("1800"), F.regexp_extract(near, dims.PHONE.split("|")[0], 0))
    maybe = key.isNotNull() | near.contains("@") | near.contains("1800") | near.rlike(r"[6-9]\d{9}")
    contact = tx.let(F.struct(email.alias("email"), phone.alias("phone")), lambda c: F.struct(
        F.nullif(c["email"], F.lit("")).alias("email"), F.nullif(c["phone"], F.lit("")).alias("phone")))

    def read(c: Column) -> Column:
        found = c["email"].isNotNull() | c["phone"].isNotNull()
        return _hit(key.isNotNull() | found, "consumer_care", "keyed",
                    F.coalesce(key["conf"], F.lit(dims.CONF_UNKEYED)), near,
                    F.concat_ws(", ", c["email"], c["phone"]),
                    _line_segment(F.col("line_no"), F.lit(0), F.col("len0")),
                    F.when(~found, "care heading without a number or e-mail"), contact=c)

    return F.when(maybe, tx.let(contact, read))


def common_name() -> Column:
    """Text after an explicit name key, up to the end of its line."""
    key = F.col("key_commodity_name")

    def read(start: Column) -> Column:
        size = F.greatest(F.col("len0") - start, F.lit(0))
        value = F.trim(F.substring(F.col("wtext"), start + 1, size), F.lit(" :-"))
        return _hit(key.isNotNull(), "commodity_name", "keyed", F.lit(1.0), F.col("wtext"), value,
                    _line_segment(F.col("line_no"), F.lit(0), F.col("len0")), F.lit(None).cast("string"))

    return F.when(key.isNotNull(), tx.let(F.coalesce(_raw_pos(key["end"]), F.lit(0)), read))


def candidates(lines: DataFrame, use_fuzzy: bool = True, strict_compat: bool = False,
               fields: list[str] | None = None, only: str | None = None) -> DataFrame:
    """Every hit of every stage, or of the stage ``only``, one row per (line, stage)."""
    keyed = match_keys(line_context(lines), use_fuzzy, fields)
    stages = {
        "mrp": {"keyed": mrp_keyed(keyed), "currency": mrp_currency(), "slash": mrp_slash(), "legend": mrp_legend()},
        "net_quantity": {"keyed": net_quantity()},
        "mfg_date": {"keyed": mfg_keyed(strict_compat), "bare": mfg_bare()},
        "manufacturer": {"keyed": manufacturer()}, "consumer_care": {"keyed": consumer_care()}, "commodity_name": {"keyed": common_name()},
    }
    wanted = [h for f in (fields or dims.FIELDS) for name, h in stages[f].items() if only in (None, name)]
    return keyed.select("scan_id", F.col("line_no").alias("key_line"),
                        F.explode(F.array_compact(F.array(*[h.cast(HIT) for h in wanted]))).alias("hit"))


def stage_best(cands: DataFrame) -> DataFrame:
    """Best hit per scan, field and stage: confidence first, then the earlier line."""
    order = F.struct((-F.col("hit.match_confidence")).alias("c"), F.col("key_line"))
    return cands.groupBy("scan_id", F.col("hit.field").alias("field"), F.col("hit.stage").alias("stage")).agg(
        F.min_by("hit", order).alias("hit"))


def best_hit(cands: DataFrame) -> DataFrame:
    """One hit per scan and field after the stage cascades.

    A later stage counts only when the earlier ones found nothing; the legend stage also
    replaces a hit below 0.5.
    """
    order = F.struct((-F.col("hit.match_confidence")).alias("c"), F.col("key_line"))

    def first(stage: str) -> Column:
        mine = F.col("hit.stage") == stage
        return F.min_by(F.when(mine, F.col("hit")), F.when(mine, order))

    best = cands.groupBy("scan_id", F.col("hit.field").alias("field")).agg(
        *[first(s).alias(s) for s in ("keyed", "currency", "slash", "legend", "bare")])
    held = F.coalesce("keyed", "currency", "slash", "bare")
    weak = held.isNull() | (held["match_confidence"] < dims.MIN_JUDGE_CONF)
    return best.select("scan_id", "field", F.when(F.col("legend").isNotNull() & weak, F.col("legend"))
                       .otherwise(held).alias("hit"))


def densify_fields(hits: DataFrame, scans: DataFrame, declarations: DataFrame) -> DataFrame:
    """Six rows per scan; an absent declaration gets its note and flag.

    ``declarations`` is the fixed list of six.
    """
    frame = scans.select("scan_id").crossJoin(F.broadcast(
        declarations.select("field", "ord", "requirement", "informational", "assessable_by_rule", "absent_note")))
    hit = F.col("hit")
    return frame.join(hits, ["scan_id", "field"], "left").select(
        "scan_id", "field", "ord", "requirement", "informational", hit.isNotNull().alias("present"),
        (hit.isNotNull() | F.col("assessable_by_rule")).alias("assessable"),
        F.coalesce(hit["raw_text"], F.lit("")).alias("raw_text"),
        F.coalesce(hit["value_text"], F.lit("")).alias("value_text"),
        hit["quantity"].alias("quantity"), hit["price"].alias("price"), hit["mfg"].alias("mfg"),
        hit["contact"].alias("contact"), hit["segments"].alias("segments"), hit["line_no"].alias("line_no"),
        F.when(hit.isNull(), F.col("absent_note")).otherwise(hit["note"]).alias("note"),
        F.coalesce(hit["match_confidence"], F.lit(0.0)).alias("match_confidence"))


def extract_fields(lines: DataFrame, scans: DataFrame, declarations: DataFrame, use_fuzzy: bool = True,
                   strict_compat: bool = False) -> DataFrame:
    """Lines to six declaration rows per scan."""
    return densify_fields(best_hit(candidates(lines, use_fuzzy, strict_compat)), scans, declarations)


def value_boxes(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """The box around the words of each hit's value.

    Only winning hits meet their lines, by (scan, line).
    """
    parts = hits.where("present").select("scan_id", "field", F.explode("segments").alias("seg")).select(
        "scan_id", "field", F.col("seg.line_no").alias("line_no"), F.col("seg.from").alias("a"),
        F.col("seg.to").alias("b"))
    words = parts.join(lines.select("scan_id", "line_no", "words"), ["scan_id", "line_no"]).select(
        "scan_id", "field", F.explode(F.filter(
            "words", lambda v: (v["s"] < F.col("b")) & (v["e"] > F.col("a")))).alias("v"))
    x, y, w, h = (F.col(f"v.{c}") for c in ("x", "y", "w", "h"))
    return words.groupBy("scan_id", "field").agg(
        F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x + w) - F.min(x)).alias("w"),
        (F.max(y + h) - F.min(y)).alias("h"))
