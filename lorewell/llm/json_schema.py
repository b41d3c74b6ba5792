"""Validation against JSON schemas, in DataFrame and SQL operations alone.

Each pair of a schema and a value is a node. Nodes are expanded level by level: members, items and schemas that apply to the same value (allOf,
anyOf, $ref and the like) are the nodes of the next level. Results then go up again, level by level. They are true, false or null,
where null stands for what can't be told: a keyword of _UNTOLD, a $ref out of the schema or in a circle, a pattern beyond _told().
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import DataFrame, SparkSession

from lorewell.llm.shared import materialize

_UNTOLD = ("unevaluatedProperties", "unevaluatedItems", "$dynamicRef", "$recursiveRef", "dependencies")
#: How a node bears on the one above it.
_HOW = ("all", "anyOf", "oneOf", "not", "contains", "if", "then", "else")


def _pattern_grammar() -> tuple[str, str, str, str]:
    ranges = "|".join(f"{c}-[{c}-{run[-1]}]" for run in (digits, ascii_lowercase, ascii_uppercase) for c in run)
    escape = r"\\[dDwWsStnrf.,/:@#%_=\\()\[\]{}*+?|^$\-]"
    inside = rf"\[\^?-?(?:{ranges}|[^-\[\]&\\])*-?\]"
    sequence = r"(?:[^()\[\]{}*+?|\\](?:(?:[*+?]|\{[0-9]{1,3}(?:,[0-9]{0,3})?\})\??)?|\|)*"
    return escape, inside, sequence, rf"\((?:\?[:=!])?{sequence}\)"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _told(p: str) -> str:
    """SQL: whether Java reads the pattern p, and as ECMA does: common escapes, classes with ranges of letters or digits, groups ten deep."""
    escape, inside, sequence, group = _pattern_grammar()
    # An escape stands as a letter that is no end of a range.
    out = f"regexp_replace({p}, {_sql(escape)}, '\u0001')"
    out = f"regexp_replace({out}, {_sql(inside)}, 'a')"
    for _ in range(10):
        out = f"regexp_replace({out}, {_sql(group)}, 'a')"
    counts = rf"regexp_extract_all({p}, {_sql(r'[{]([0-9]{1,3},[0-9]{1,3})[}]')}, 1)"
    ordered = f"forall({counts}, c -> CAST(split_part(c, ',', 1) AS INT) <= CAST(split_part(c, ',', 2) AS INT))"
    return f"(regexp_like({out}, {_sql(f'^{sequence}$')}) AND length({_without_empty(p)}) = length({p}) AND {ordered})"


def _without_empty(p: str) -> str:
    """SQL: p without empty classes, which Java reads otherwise."""
    return f"replace(replace({p}, '[]', ''), '[^]', '')"


def _like(text: str, p: str) -> str:
    """SQL: whether the pattern p is found in text; null if it can't be told. A last $ is the very end."""
    java = f"regexp_replace({p}, {_sql(r'(?<!\\)[$]$')}, {_sql(r'\\z')})"
    return f"CASE WHEN {_told(p)} THEN regexp_like({text}, {java}) END"


def _kw(name: str) -> str:
    return f"variant_get(s, '$[\"{name}\"]', 'variant')"


def _json(name: str) -> str:
    return f"to_json({_kw(name)})"


def _less(a: str, b: str) -> str:
    """SQL: a < b of numbers as JSON; long integers to the last digit."""
    x, y = f"try_cast({a} AS DOUBLE)", f"try_cast({b} AS DOUBLE)"
    return f"({x} < {y} OR ({x} = {y} AND coalesce(try_cast({a} AS DECIMAL(38,9)) < try_cast({b} AS DECIMAL(38,9)), false)))"


def _equal(a: str, b: str) -> str:
    return f"({a} = {b} OR coalesce(try_cast({a} AS DOUBLE) = try_cast({b} AS DOUBLE) AND NOT {_less(a, b)} AND NOT {_less(b, a)}, false))"


_KIND = """CASE left(value, 1) WHEN '{' THEN 'object' WHEN '[' THEN 'array' WHEN '"' THEN 'string' WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' WHEN 'n' THEN 'null' ELSE 'number' END"""


def _own() -> str:
    """SQL: what the schema says of the value itself; null if it can't be told."""
    number, string, array, obj = (f"kind = '{k}'" for k in ("number", "string", "array", "object"))
    is_type = "(t = kind OR (t = 'integer' AND kind = 'number' AND try_cast(value AS DOUBLE) = floor(try_cast(value AS DOUBLE))))"
    types = "coalesce(from_json(to_json(type), 'array<string>'), array(variant_get(type, '$', 'string')))"
    size = "CASE WHEN kind = 'string' THEN char_length(text) WHEN kind = 'array' THEN json_array_length(value) WHEN kind = 'object' THEN size(names) END"
    rules = [
        ("type", f"exists({types.replace('type', _kw('type'))}, t -> {is_type})", "true"),
        ("enum", f"exists(from_json({_json('enum')}, 'array<variant>'), x -> {_equal('coalesce(to_json(x), \'null\')', 'value')})", "true"),
        ("const", _equal(_json("const"), "value"), "true"),
        ("minimum", f"NOT {_less('value', _json('minimum'))}", number),
        ("maximum", f"NOT {_less(_json('maximum'), 'value')}", number),
        ("exclusiveMinimum", f"CASE WHEN {_json('exclusiveMinimum')} = 'false' THEN true WHEN {_json('exclusiveMinimum')} = 'true' THEN {_less(_json('minimum'), 'value')} ELSE {_less(_json('exclusiveMinimum'), 'value')} END", number),
        ("exclusiveMaximum", f"CASE WHEN {_json('exclusiveMaximum')} = 'false' THEN true WHEN {_json('exclusiveMaximum')} = 'true' THEN {_less('value', _json('maximum'))} ELSE {_less('value', _json('exclusiveMaximum'))} END", number),
        ("multipleOf", f"try_mod(try_cast(value AS DECIMAL(38,15)), try_cast({_json('multipleOf')} AS DECIMAL(38,15))) = 0", number),
        ("pattern", _like("text", "pattern"), string),
        ("uniqueItems", f"{_json('uniqueItems')} = 'false' OR size(array_distinct(transform(from_json(value, 'array<variant>'), x -> coalesce(to_json(x), 'null')))) = json_array_length(value)", array),
        ("required", f"{_json('required')} IN ('true', 'false') OR size(array_except(from_json({_json('required')}, 'array<string>'), names)) = 0", obj),
        ("dependentRequired", f"forall(map_entries(from_json({_json('dependentRequired')}, 'map<string,array<string>>')), e -> NOT array_contains(names, e.key) OR size(array_except(e.value, names)) = 0)", obj),
        ("patternProperties", f"forall(map_keys(from_json({_json('patternProperties')}, 'map<string,variant>')), p -> {_told('p')} OR NULL)", obj),
    ]
    for kind, noun in (("string", "Length"), ("array", "Items"), ("object", "Properties")):
        rules += [(f"min{noun}", f"{size} >= try_cast({_json('min' + noun)} AS DOUBLE)", f"kind = '{kind}'"), (f"max{noun}", f"{size} <= try_cast({_json('max' + noun)} AS DOUBLE)", f"kind = '{kind}'")]
    parts = [f"CASE WHEN {_kw(name)} IS NULL OR NOT ({when}) THEN true ELSE ({test}) END" for name, test, when in rules]
    parts += [f"CASE WHEN {_kw(name)} IS NULL THEN true END" for name in _UNTOLD]
    parts.append("CASE WHEN ref IS NULL OR target IS NOT NULL THEN true END")
    return "CASE WHEN schema = 'false' THEN false WHEN NOT startswith(schema, '{') THEN true ELSE " + " AND ".join(parts) + " END"


_PARSED = f"""
SELECT *, CASE WHEN array_contains(seen, ref) THEN NULL WHEN ref = '#' THEN root WHEN NOT regexp_like(ref, '^#(/[^~%\\'/]+)+$') THEN NULL
          ELSE get_json_object(root, concat("$['", replace(substring(ref, 3), '/', "']['"), "']")) END AS goal
FROM (SELECT *, {_KIND} AS kind, variant_get(v, '$', 'string') AS text, CASE WHEN startswith(value, '{{') THEN json_object_keys(value) END AS names,
             try_variant_get(s, '$.pattern', 'string') AS pattern, try_variant_get(s, '$["$ref"]', 'string') AS ref
      FROM (SELECT *, try_parse_json(schema) AS s, try_parse_json(value) AS v FROM @nodes@))
"""

_CHILD = "SELECT {key}, concat(id, '.', '{tag}', {place}) AS id, id AS up, '{how}' AS how, {schema} AS schema, {value} AS value, root, {seen} AS seen FROM {source} WHERE {schema} IS NOT NULL"


def _children(key: str) -> str:
    """SQL: the nodes of the next level."""
    def child(tag: str, how: str, schema: str, value: str = "value", place: str = "''", source: str = "@parsed@", seen: str = "CAST(array() AS ARRAY<STRING>)") -> str:
        return _CHILD.format(key=key, tag=tag, how=how, schema=schema, value=value, place=place, source=source, seen=seen)

    named = f"from_json({_json('properties')}, 'map<string,variant>')"
    shaped = f"coalesce(from_json({_json('patternProperties')}, 'map<string,variant>'), map())"
    fits = f"map_filter({shaped}, (p, x) -> coalesce({_like('key', 'p')}, false))"
    members = f"""(SELECT *, to_json(try_element_at({named}, key)) AS named, {fits} AS fits
        FROM (SELECT p.*, k.pos AS at, k.key, to_json(k.value) AS item FROM @parsed@ AS p, LATERAL variant_explode(v) AS k WHERE kind = 'object'))"""
    shapes = f"(SELECT *, f.pos AS nth, to_json(f.col) AS shape FROM {members}, LATERAL posexplode(map_values(fits)) AS f(pos, col))"
    prefix = f"coalesce(from_json({_json('prefixItems')}, 'array<variant>'), CASE WHEN startswith({_json('items')}, '[') THEN from_json({_json('items')}, 'array<variant>') END, array())"
    rest = f"CASE WHEN startswith({_json('items')}, '[') THEN {_json('additionalItems')} ELSE {_json('items')} END"
    items = f"(SELECT *, to_json(try_element_at({prefix}, at + 1)) AS own, {prefix} AS firsts FROM (SELECT p.*, k.pos AS at, to_json(k.value) AS item FROM @parsed@ AS p, LATERAL variant_explode(v) AS k WHERE kind = 'array'))"
    given = f"(SELECT p.*, k.pos AS at, to_json(k.value) AS own FROM @parsed@ AS p, LATERAL variant_explode({_kw('dependentSchemas')}) AS k WHERE array_contains(names, k.key))"
    out = [
        child("p", "all", "named", "item", "at", members),
        child("q", "all", "shape", "item", "concat(at, '-', nth)", shapes),
        child("a", "all", f"CASE WHEN named IS NULL AND size(fits) = 0 THEN {_json('additionalProperties')} END", "item", "at", members),
        child("n", "all", _json("propertyNames"), "to_json(try_parse_json(to_json(array(key))))".replace("to_json(array(key))", "concat('\"', replace(replace(key, '\\\\', '\\\\\\\\'), '\"', '\\\\\"'), '\"')"), "at", members),
        child("i", "all", f"CASE WHEN at < size(firsts) THEN own ELSE {rest} END", "item", "at", items),
        child("c", "contains", _json("contains"), "item", "at", items),
        child("d", "all", "own", "value", "at", given, "seen"),
        child("r", "all", "target", seen="array_append(seen, ref)"),
    ]
    for tag, name in (("o", "not"), ("f", "if"), ("t", "then"), ("e", "else")):
        out.append(child(tag, name, _json(name), seen="seen"))
    for tag, name in (("A", "allOf"), ("B", "anyOf"), ("C", "oneOf")):
        each = f"(SELECT p.*, k.pos AS at, to_json(k.value) AS own FROM @parsed@ AS p, LATERAL variant_explode({_kw(name)}) AS k)"
        out.append(child(tag, "all" if name == "allOf" else name, "own", "value", "at", each, "seen"))
    return "\nUNION ALL\n".join(out)


def _result() -> str:
    """SQL: a node's result, of its own one and the counts of those below it: how many, true, untold."""
    n, t, u = ({h: f"coalesce({c}_{h}, 0)" for h in _HOW} for c in "ntu")
    one = {h: f"(CASE WHEN {n[h]} = 0 OR {t[h]} = 1 THEN true WHEN {u[h]} = 0 THEN false END)" for h in _HOW}
    low, high = "coalesce(least_found, 1)", "coalesce(most_found, 1e300)"
    return f"""own AND (CASE WHEN {t["all"]} + {u["all"]} < {n["all"]} THEN false WHEN {u["all"]} = 0 THEN true END)
      AND (CASE WHEN {n["anyOf"]} = 0 OR {t["anyOf"]} > 0 THEN true WHEN {u["anyOf"]} = 0 THEN false END)
      AND (CASE WHEN {n["oneOf"]} = 0 THEN true WHEN {t["oneOf"]} > 1 THEN false WHEN {u["oneOf"]} = 0 THEN {t["oneOf"]} = 1 END)
      AND (CASE WHEN {n["not"]} = 0 THEN true WHEN {u["not"]} = 0 THEN {t["not"]} = 0 END)
      AND (CASE WHEN NOT finds OR ({u["contains"]} = 0 AND {t["contains"]} BETWEEN {low} AND {high}) THEN true
                WHEN {t["contains"]} + {u["contains"]} < {low} OR {t["contains"]} > {high} OR {u["contains"]} = 0 THEN false END)
      AND (CASE WHEN {n["if"]} = 0 THEN true WHEN {t["if"]} = 1 THEN {one["then"]} WHEN {u["if"]} = 0 THEN {one["else"]} WHEN {one["then"]} AND {one["else"]} THEN true END)"""


def _run(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """SQL with the frames in the places of @name@; braces are the text's own."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in frames:
        text = text.replace(f"@{name}@", f"{{{name}}}")
    return spark.sql(text, **frames)


def validate(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key and valid for each row of pairs (key, schema, value), whose schema and value are JSON as to_json writes a variant; key tells rows apart.
    Rounds grow with the depth of schemas and values."""
    spark = pairs.sparkSession
    # Names of their own, as rows are joined with what variant_explode gives.
    outer, key = key, [f"key_{i}" for i in range(len(key))]
    keys = ", ".join(key)
    pairs = pairs.selectExpr(*(f"{o} AS {k}" for o, k in zip(outer, key, strict=True)), "schema", "value")
    nodes = pairs.selectExpr(*key, "'' AS id", "CAST(NULL AS STRING) AS up", "'all' AS how", "schema", "value", "schema AS root", "CAST(array() AS ARRAY<STRING>) AS seen")
    levels = []
    while True:
        nodes = materialize(nodes)
        if nodes.isEmpty():
            break
        # A goal of a $ref is written as a variant writes it.
        parsed = _run(spark, _PARSED, nodes=nodes).selectExpr("*", "to_json(try_parse_json(goal)) AS target")
        found = f"kind = 'array' AND {_kw('contains')} IS NOT NULL"
        levels.append(parsed.selectExpr(*key, "id", "up", "how", f"{_own()} AS own", f"coalesce({found}, false) AS finds", f"try_cast({_json('minContains')} AS DOUBLE) AS least_found", f"try_cast({_json('maxContains')} AS DOUBLE) AS most_found"))
        nodes = _run(spark, _children(keys), parsed=parsed)
    below = None
    for level in reversed(levels):
        if below is None:
            below = spark.createDataFrame([], level.selectExpr(*key, "id", "up", "how", "own AS result").schema)
        counts = ", ".join(f"count_if(how = '{h}') AS n_{h}, count_if(how = '{h}' AND result) AS t_{h}, count_if(how = '{h}' AND result IS NULL) AS u_{h}" for h in _HOW)
        same = " AND ".join(f"l.{k} <=> b.{k}" for k in [*key, "id"])
        of_level = ", ".join(f"l.{k}" for k in [*key, "id", "up", "how"])
        below = materialize(_run(
            spark,
            f"SELECT {of_level}, {_result()} AS result FROM @level@ AS l LEFT JOIN (SELECT {keys}, up AS id, {counts} FROM @below@ GROUP BY {keys}, up) AS b ON {same}",
            level=level, below=below,
        ))
    return (below if below is not None else pairs.selectExpr(*key, "true AS result")).selectExpr(*(f"{k} AS {o}" for o, k in zip(outer, key, strict=True)), "result AS valid")
