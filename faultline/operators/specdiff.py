"""Differences of two schema snapshots: one full outer join of their facts, all rules in one pass over it.

A rule is a condition on the two sides of a fact; unknown (null) attributes make it silent. Records are (spec_id, kind,
breaking, warning, anchor, detail).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions.text import content_address, parent_path
from ..sources.specs import VACUOUS

_RECORD = ["spec_id", "kind", "breaking", "warning", "anchor", "detail"]
_KEY = ["spec_id", "op", "part", "grp", "name"]


def to_changes(records: DataFrame, provider: str, label: str, date: str | None) -> DataFrame:
    """Difference records (kind, breaking, anchor, detail, and others, which stay) as change rows."""
    valid = records.where(F.col("kind").isNotNull() & F.col("anchor").isNotNull())
    detail = F.coalesce("detail", F.lit(""))
    title = F.concat(F.col("kind"), F.lit(": "), F.col("anchor"), F.when(detail != "", F.concat(F.lit(" "), detail)).otherwise(""))
    url = F.concat(F.lit(f"specdiff://{provider}/{label}#"), content_address("kind", "anchor", detail))
    body = F.to_json(F.struct("kind", "anchor", detail.alias("detail"), F.coalesce("breaking", F.lit(False)).alias("breaking")))
    return valid.withColumns(
        {
            "provider": F.lit(provider), "source_repo": F.lit(f"spec-diff:{label}"), "title": F.substring(title, 1, 300), "change_type": F.when(F.col("breaking"), "breaking").otherwise("additive"),
            "classifier": F.lit("spec-diff-v1"), "effective_date": F.lit(date).cast("string"), "source_url": url, "raw_excerpt": body,
        }
    )


def _o(c: str) -> Column:
    return F.col(f"o.{c}")


def _n(c: str) -> Column:
    return F.col(f"n.{c}")


def _record(test: Column, kind: Column | str, detail: Column | str = "", breaking: bool = True, warning: bool = False) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(test, F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(breaking).alias("breaking"), F.lit(warning).alias("warning"), text.alias("detail")))


def _fired(rows: DataFrame, records: list[Column], anchor: Column, *keep: str) -> DataFrame:
    one = F.array(*records)
    out = rows.select("spec_id", anchor.alias("anchor"), *keep, F.explode(F.filter(one, lambda r: r.isNotNull())).alias("r"))
    return out.select("spec_id", "r.kind", "r.breaking", "r.warning", "anchor", "r.detail", *keep)


def _values(test: Column, a: Column, b: Column, kind: str, prefix: Column, breaking: bool) -> Column:
    """Records for each value of ``a`` that ``b`` lacks."""
    each = F.transform(F.array_except(a, b), lambda v: F.struct(F.lit(kind).alias("kind"), F.lit(breaking).alias("breaking"), F.lit(False).alias("warning"), F.concat(prefix, v).alias("detail")))
    return F.when(test & a.isNotNull() & b.isNotNull(), each)


def _number(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0\z", "")


def _joined(old: DataFrame, new: DataFrame) -> DataFrame:
    side = lambda d: d.select(*_KEY, F.struct(*(c for c in d.columns if c not in _KEY), F.lit(True).alias("there")).alias("s"))
    return side(old).withColumnRenamed("s", "o").join(side(new).withColumnRenamed("s", "n"), _KEY, "full")


def _in_old() -> Column:
    return F.col("o").isNotNull()


def _in_new() -> Column:
    return F.col("n").isNotNull()


def _both() -> Column:
    return _in_old() & _in_new()


def _explicit(c: str) -> Column:
    return _o(c).isNotNull() & _n(c).isNotNull()


def _listed(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def _plain_union() -> Column:
    return ~F.coalesce(_o("via_union"), F.lit(False)) & ~F.coalesce(_n("via_union"), F.lit(False))


def _item(side) -> Column:
    return F.coalesce(side("item_root"), F.lit(False)) | F.col("name").endswith("[]")


def _tightened(name: Column) -> Column:
    test = _both() & _o("accepts_empty") & ~_n("accepts_empty") & _n("branch_required").isNotNull()
    return _record(test, "request-prop-union-required-tightened", F.concat(name, F.lit(": every union branch now requires "), _listed(_n("branch_required"))))


def _shallow(surface: str) -> tuple[list[Column], list[Column]]:
    """Rules of properties: single records, and arrays of records. ``known`` says whether the old body has the parent."""
    name, request = F.col("name"), F.lit(surface == "request")
    gone = _in_old() & ~_in_new() & ~_item(_o)
    fresh = ~_in_old() & _in_new() & ~_item(_n)
    parent_new = name.contains(".") & ~F.col("known")
    required_now = request & _n("required") & ~parent_new
    free = _both() & request & _plain_union()
    more_items = (_explicit("min_items") & (_n("min_items") > _o("min_items"))) | (_o("min_items").isNull() & (_o("type") == "array"))
    single = [
        _record(gone, f"{surface}-prop-removed", name),
        _record(_both() & (_o("type") != _n("type")), f"{surface}-prop-type-changed", F.concat(name, F.lit(": "), _o("type"), F.lit(" -> "), _n("type"))),
        _record(_both() & ~request & ~_o("nullable") & _n("nullable"), "response-prop-became-nullable", name),
        _record(_both() & request & _o("nullable") & ~_n("nullable"), "request-prop-became-not-nullable", name),
        F.when(request, _tightened(name)),
        _record(free & _o("pattern").isNull() & _n("pattern").isNotNull(), "request-prop-pattern-added", F.concat(name, F.lit(" pattern "), _n("pattern"))),
        _record(free & _o("enum").isNull() & _o("type").isNotNull() & _n("enum").isNotNull(), "request-prop-became-enum", F.concat(name, F.lit(" enum "), _listed(_n("enum")))),
        _record(_both() & request & _o("accepts_any") & ~_n("accepts_any") & _n("any_union"), "request-prop-union-enum-tightened", F.concat(name, F.lit(": every union branch now constrained ("), F.coalesce(_n("constraints"), F.lit("")), F.lit(")"))),
        _record(free & (_n("max_length") < _o("max_length")), "request-prop-max-length-decreased", F.concat(name, F.lit(": maxLength "), _number(_o("max_length")), F.lit(" -> "), _number(_n("max_length")))),
        _record(free & (_n("max_items") < _o("max_items")), "request-prop-max-items-decreased", F.concat(name, F.lit(": maxItems "), _number(_o("max_items")), F.lit(" -> "), _number(_n("max_items")))),
        _record(free & (_n("min_items") >= 1) & more_items, "request-prop-min-items-increased", F.concat(name, F.lit(": minItems "), F.coalesce(_number(_o("min_items")), F.lit("none")), F.lit(" -> "), _number(_n("min_items")))),
        _record(free & ~_o("required") & _n("required"), "request-prop-became-required", name),
        _record(_both() & ~request & _plain_union() & _o("required") & ~_n("required"), "response-prop-became-optional", name, breaking=False, warning=True),
        _record(fresh & required_now, "request-prop-added-required", name),
        _record(fresh & ~F.coalesce(required_now, F.lit(False)), f"{surface}-prop-added", name, breaking=False),
    ]
    prefix = F.concat(name, F.lit(" = "))
    many = [_values(_both(), _o("enum"), _n("enum"), "enum-value-removed", prefix, True), _values(_both(), _n("enum"), _o("enum"), "enum-value-added", prefix, False)]
    return single, many


def _deep() -> tuple[list[Column], list[Column]]:
    """Rules below the shallow depth: ``known`` and ``now`` say whether the deep names of either side have the parent."""
    name = F.col("name")
    nested = name.contains(".")
    gone = _in_old() & ~_in_new() & ~_item(_o) & ~(nested & F.col("known") & ~F.col("now"))
    free = _both() & _plain_union()
    fresh = ~_in_old() & _in_new() & _n("required") & ~(nested & ~F.col("known")) & ~F.coalesce(_n("via_union"), F.lit(False))
    single = [
        _record(gone, "request-prop-removed", name),
        _record(_both() & (_o("type") != _n("type")), "request-prop-type-changed", F.concat(name, F.lit(": "), _o("type"), F.lit(" -> "), _n("type"))),
        _record(free & ~_o("required") & _n("required"), "request-prop-became-required", name),
        _record(free & _o("pattern").isNull() & _n("pattern").isNotNull(), "request-prop-pattern-added", F.concat(name, F.lit(" pattern "), _n("pattern"))),
        _record(fresh, "request-prop-added-required", name),
    ]
    return single, [_values(free, _o("enum"), _n("enum"), "enum-value-removed", F.concat(name, F.lit(" = ")), True)]


def _branch() -> tuple[list[Column], list[Column]]:
    name = F.col("name")
    gone = _in_old() & ~_in_new() & ~_o("via_union") & ~(name.contains(".") & F.col("known") & ~F.col("now"))
    free = _both() & _plain_union()
    single = [_record(gone, "request-prop-removed", name), _record(free & ~_o("required") & _n("required"), "request-prop-became-required", name)]
    return single, [_values(free, _o("enum"), _n("enum"), "enum-value-removed", F.concat(name, F.lit(" = ")), True)]


def _param() -> list[Column]:
    name = F.col("name")
    lost = F.array_except(_o("types"), _n("types"))
    some = _both() & _explicit("types") & (F.size(lost) > 0)
    all_ = F.size(lost) == F.size(_o("types"))
    return [
        _record(_in_old() & ~_in_new(), "param-removed", name),
        _record(_both() & ~_o("required") & _n("required"), "param-now-required", name),
        _record(some & ~all_, "param-type-narrowed", F.concat(name, F.lit(": -"), F.array_join(F.array_sort(lost), ",-"))),
        _record(some & all_, "param-type-changed", F.concat(name, F.lit(": "), F.array_join(_o("types"), "|"), F.lit(" -> "), F.array_join(_n("types"), "|"))),
        _record(_both() & (_n("min_length") > _o("min_length")), "param-min-length-increased", F.concat(name, F.lit(": minLength "), _number(_o("min_length")), F.lit(" -> "), _number(_n("min_length")))),
        _record(_both() & (_n("max_length") < _o("max_length")), "param-max-length-decreased", F.concat(name, F.lit(": maxLength "), _number(_o("max_length")), F.lit(" -> "), _number(_n("max_length")))),
        _record(_both() & _o("pattern").isNull() & F.array_contains(_o("types"), "string") & _n("pattern").isNotNull() & ~_n("pattern").isin(VACUOUS), "param-pattern-added", F.concat(name, F.lit(" pattern "), _n("pattern"))),
        _record(~_in_old() & _n("required"), "param-added-required", name),
        _record(~_in_old() & ~_n("required"), "param-added-optional", name, breaking=False),
    ]


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of the differences of facts ``old`` and ``new``, pair by ``spec_id``. The facts and their join become
    tables first, since every group of rules reads them."""
    old, new = scratch.materialise(old, "facts"), scratch.materialise(new, "facts")
    ops = [d.where("part = 'op'").select("spec_id", "op", F.split("op", " ")[1].alias("path")) for d in (old, new)]
    paths = [o.select("spec_id", "path").distinct() for o in ops]
    said = lambda d, kind, anchor, breaking: d.select("spec_id", F.lit(kind).alias("kind"), F.lit(breaking).alias("breaking"), F.lit(False).alias("warning"), F.col(anchor).alias("anchor"), F.lit("").alias("detail"))
    out = said(paths[0].join(paths[1], ["spec_id", "path"], "left_anti"), "path-removed", "path", True)
    out = out.unionByName(said(paths[1].join(paths[0], ["spec_id", "path"], "left_anti"), "path-added", "path", False))
    out = out.unionByName(said(ops[0].join(ops[1], ["spec_id", "op"], "left_anti").join(paths[1], ["spec_id", "path"], "left_semi"), "operation-removed", "op", True))
    out = out.unionByName(said(ops[1].join(ops[0], ["spec_id", "op"], "left_anti").join(paths[0], ["spec_id", "path"], "left_semi"), "operation-added", "op", False))

    shared = ops[0].select("spec_id", "op").join(ops[1].select("spec_id", "op"), ["spec_id", "op"])
    rows = scratch.materialise(_joined(old, new).join(shared, ["spec_id", "op"]), "joined")
    op, part = F.col("op"), lambda *p: rows.where(F.col("part").isin(*p))

    out = out.unionByName(_fired(part("param"), _param(), op))
    enum_name = F.concat(F.col("name"), F.lit(" "), F.when(F.col("grp") != "", F.concat(F.col("grp"), F.lit(" "))).otherwise(""), F.lit("= "))
    lost = part("param-enum").select("spec_id", op.alias("anchor"), F.explode(_values(_both(), _o("enum"), _n("enum"), "param-enum-value-removed", enum_name, True)).alias("r"))
    out = out.unionByName(lost.select("spec_id", "r.kind", "r.breaking", "r.warning", "anchor", "r.detail"))
    closed = part("param-enum").where((F.col("grp") == "") & ~_in_old()).select("spec_id", "op", "name", _n("enum").alias("values"))
    closed = closed.join(part("param").where(_both() & _o("plain") & _n("plain") & _o("types").isNotNull()).select("spec_id", "op", "name"), ["spec_id", "op", "name"])
    out = out.unionByName(_fired(closed, [_record(F.lit(True), "param-became-enum", F.concat(F.col("name"), F.lit(" enum "), _listed(F.col("values"))))], op))
    body = [
        _record(_o("plain") & ~_n("plain"), "request-body-removed"),
        _record(_o("plain") & _n("plain") & ~_o("required") & _n("required"), "request-body-became-required"),
        _record(~_o("plain") & _n("plain") & _n("required"), "request-body-added-required"),
    ]
    out = out.unionByName(_fired(part("op"), body, op))
    sides = part("media").groupBy("spec_id", "op").agg(F.bool_or(_in_old()).alias("had"), F.bool_or(_in_new()).alias("has"))
    media = part("media").join(sides, ["spec_id", "op"])
    out = out.unionByName(_fired(media, [_record(_in_old() & ~_in_new() & F.col("had") & F.col("has"), "request-media-type-removed", F.col("name"))], op))
    ok_status = F.col("name").rlike(r"^2\d\d\z")
    status = [_record(_in_old() & ~_in_new() & ok_status, "response-status-removed"), _record(_both() & ok_status & (_o("type") != _n("type")), "response-body-type-changed", F.concat(_o("type"), F.lit(" -> "), _n("type")))]
    out = out.unionByName(_fired(part("status"), status, F.concat(op, F.lit(" -> "), F.col("name"))))

    # Bodies: for each property, which side has its parent, and bodies that both sides have. Names meet by joins, since a body's names
    # beside each of them would be their square.
    body_key = ["spec_id", "op", "part", "grp"]
    props = part("prop", "deep", "media-prop", "media-deep", "branch-prop", "response-prop")
    holders = props.groupBy(*body_key, F.col("name").alias("parent")).agg(F.bool_or(_in_old()).alias("known"), F.bool_or(_in_new()).alias("now"))
    parted = props.withColumn("parent", parent_path("name"))
    nested = parted.where(F.col("name").contains(".")).join(holders, [*body_key, "parent"], "left")
    nested = nested.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("known", "now")}).drop("parent")
    flat = parted.where(~F.col("name").contains(".")).withColumns({"known": F.lit(False), "now": F.lit(False)}).drop("parent")
    props = scratch.materialise(flat.unionByName(nested), "props")
    shallow = rows.where(F.col("part").isin("prop", "media-prop")).select("spec_id", "op", F.when(F.col("part") == "prop", "deep").otherwise("media-deep").alias("part"), "grp", "name")
    bodies = part("media", "status", "branch").where(_both() & ((F.col("part") == "branch") & (_o("type") == _n("type")) | (F.col("part") != "branch") & _o("plain") & _n("plain")))
    bodies = bodies.select("spec_id", "op", F.when(F.col("part") == "media", "media").when(F.col("part") == "status", "response").otherwise("branch").alias("body"), F.col("name").alias("grp"), _o("type").alias("disc"))

    def fire(rows: DataFrame, rules: tuple[list[Column], list[Column]], anchor: Column) -> DataFrame:
        single, many = rules
        found = F.concat(F.filter(F.array(*single), lambda r: r.isNotNull()), *(F.coalesce(m, F.array().cast("array<struct<kind:string,breaking:boolean,warning:boolean,detail:string>>")) for m in many))
        found = rows.select("spec_id", "op", "grp", anchor.alias("anchor"), F.explode(found).alias("r"))
        return found.select("spec_id", "r.kind", "r.breaking", "r.warning", "anchor", "r.detail", "op", "grp")

    of = lambda p: props.where(F.col("part") == p)
    in_body = lambda d, b: d.join(bodies.where(F.col("body") == b).select("spec_id", "op", "grp", "disc"), ["spec_id", "op", "grp"])
    below = lambda d: d.join(shallow, [*body_key, "name"], "left_anti")
    request = fire(of("prop"), _shallow("request"), op).unionByName(fire(below(of("deep")), _deep(), op)).select(*_RECORD)
    response = fire(in_body(of("response-prop"), "response"), _shallow("response"), F.concat(op, F.lit(" -> "), F.col("grp"))).select(*_RECORD)
    roots = _fired(part("media").where(_both() & _o("plain") & _n("plain")), [_tightened(F.lit("body root"))], op)
    again = fire(in_body(of("media-prop"), "media"), _shallow("request"), op).unionByName(fire(in_body(below(of("media-deep")), "media"), _deep(), op)).select(*_RECORD).unionByName(roots)
    filed = out.unionByName(request)
    key = ["spec_id", "kind", "anchor", "detail"]
    filed = filed.unionByName(again.dropDuplicates(key).join(filed.select(*key), key, "left_anti").select(*_RECORD))
    branch = fire(in_body(of("branch-prop"), "branch").where(F.col("name") != F.col("disc")), _branch(), op)
    branch = branch.join(filed.select(*key), key, "left_anti").withColumn("detail", F.concat("detail", F.lit(" (branch "), "grp", F.lit(")")))
    return filed.unionByName(branch.select(*_RECORD)).unionByName(response)


def ordered(records: DataFrame) -> DataFrame:
    """Breaking first, then anchor and kind as people sort them."""
    return records.orderBy(F.col("breaking").desc(), F.collate("anchor", "UNICODE"), F.collate("kind", "UNICODE"), "detail")
