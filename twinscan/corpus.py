"""A labelled corpus: pairs of snippets that must, or must not, be reported as twins.

Every snippet below is a seed. Rewrites that keep what code does (other names, other spelling) make pairs that must
be found; changes of what it does, and pairs of different seeds, make pairs that must not. The labels follow from how
a pair was made, so the confusion matrix of an analysis needs no file beside this one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscan.engine import analyze
from twinscan.options import Options


class Case(NamedTuple):
    case_id: str
    mode: str
    left: str
    right: str
    expected: bool


# name, parameters (name: type), result, statements; every local name ends in a capital letter's word so that it can be renamed.
FUNCTIONS = {
    "countReady": ("jobList: Job[], minRank: number", "number", ["let foundJobs = 0;", "for (const oneJob of jobList) {", "  if (oneJob.ready && oneJob.rank >= minRank) {", "    foundJobs += 1;", "  }", "}", "return foundJobs;"]),
    "joinNames": ("personList: Person[]", "string", ["const nameList: string[] = [];", "for (const onePerson of personList) {", "  if (onePerson.visible) {", "    nameList.push(onePerson.label.trim());", "  }", "}", "return nameList.join(', ');"]),
    "openSession": ("userName: string, timeLimit: number", "Session", ["const freshToken = makeToken(userName);", "const endTime = clock.now() + timeLimit * 1000;", "registry.store(freshToken, endTime);", "if (registry.full()) {", "  registry.evict(endTime);", "}", "return { token: freshToken, until: endTime };"]),
    "parseRow": ("rawLine: string", "Row | null", ["const cellList = rawLine.split(';');", "if (cellList.length < 3) {", "  return null;", "}", "const firstCell = cellList[0].trim();", "const rowTotal = Number(cellList[1]) + Number(cellList[2]);", "return { key: firstCell, total: rowTotal };"]),
    "waitFor": ("probeCall: Probe, maxTries: number", "boolean", ["let tryCount = 0;", "while (tryCount < maxTries) {", "  if (probeCall.check(tryCount)) {", "    return true;", "  }", "  tryCount += 1;", "}", "return false;"]),
    "mergeStock": ("mainStock: Stock, sideStock: Stock", "Stock", ["const allParts = new Map(mainStock.parts);", "for (const [partKey, partCount] of sideStock.parts) {", "  const oldCount = allParts.get(partKey) ?? 0;", "  allParts.set(partKey, oldCount + partCount);", "}", "return { parts: allParts, stamp: Date.now() };"]),
    "pickColor": ("heatLevel: number, darkMode: boolean", "string", ["if (heatLevel > 80) {", "  return darkMode ? 'maroon' : 'red';", "}", "if (heatLevel > 40) {", "  return darkMode ? 'brown' : 'orange';", "}", "log('cool', heatLevel);", "return 'blue';"]),
    "sumTree": ("rootNode: TreeNode", "number", ["let fullSum = rootNode.weight;", "for (const childNode of rootNode.children) {", "  fullSum += sumTree(childNode);", "}", "if (fullSum > rootNode.limit) {", "  report(rootNode.name, fullSum);", "}", "return fullSum;"]),
    "sendMail": ("mailBody: string, toList: string[]", "Promise<number>", ["const cleanBody = sanitize(mailBody);", "const goodList = toList.filter((oneAddress) => oneAddress.includes('@'));", "for (const oneTarget of goodList) {", "  outbox.enqueue(oneTarget, cleanBody);", "}", "audit('mail', goodList.length);", "return outbox.flush();"]),
    "rotateGrid": ("gridCells: number[][]", "number[][]", ["const rowCount = gridCells.length;", "const newCells: number[][] = [];", "for (let colIndex = 0; colIndex < rowCount; colIndex++) {", "  newCells.push(gridCells.map((oneRow) => oneRow[colIndex]).reverse());", "}", "return newCells;"]),
    "retryDelay": ("tryIndex: number, baseDelay: number", "number", ["const rawDelay = baseDelay * Math.pow(2, tryIndex);", "const capDelay = Math.min(rawDelay, 60000);", "if (capDelay < baseDelay) {", "  throw new Error('bad delay: ' + capDelay);", "}", "metrics.observe('delay', capDelay);", "return capDelay;"]),
    "groupWords": ("wordList: string[]", "Map<string, string[]>", ["const wordGroups = new Map<string, string[]>();", "for (const oneWord of wordList) {", "  const groupKey = oneWord.charAt(0).toLowerCase();", "  const sameGroup = wordGroups.get(groupKey) ?? [];", "  sameGroup.push(oneWord);", "  wordGroups.set(groupKey, sameGroup);", "}", "return wordGroups;"]),
}
# What a changed copy of a function does differently: one operation, the order of steps, a missing step, another loop or call.
CHANGES = {
    "countReady": [("oneJob.rank >= minRank", "oneJob.rank < minRank"), ("&&", "||"), ("foundJobs += 1", "foundJobs -= oneJob.rank")],
    "joinNames": [(".trim()", ".toUpperCase()"), ("nameList.push", "nameList.unshift"), ("onePerson.label", "onePerson.id.prefix")],
    "openSession": [("clock.now() + timeLimit * 1000", "clock.now() - timeLimit / 1000"), ("registry.store(", "registry.remove("), ("registry.evict(endTime)", "registry.close(endTime)")],
    "parseRow": [("split(';')", "match(/;/)"), ("Number(cellList[1]) + Number(cellList[2])", "Number(cellList[1]) * Number(cellList[2])"), ("< 3", "!== 3")],
    "waitFor": [("while (tryCount < maxTries)", "while (tryCount >= maxTries)"), ("tryCount += 1", "tryCount *= 2"), ("probeCall.check(", "probeCall.stop(")],
    "mergeStock": [("oldCount + partCount", "oldCount - partCount"), ("allParts.set(partKey, oldCount + partCount);", "allParts.delete(partKey);"), ("Date.now()", "Math.random()")],
    "sumTree": [("fullSum += sumTree(childNode)", "fullSum -= sumTree(childNode)"), ("fullSum > rootNode.limit", "fullSum <= rootNode.limit"), ("report(", "discard(")],
    "sendMail": [("outbox.enqueue(", "outbox.cancel("), ("toList.filter(", "toList.some("), ("outbox.flush()", "outbox.clear()")],
    "rotateGrid": [("newCells.push(", "newCells.unshift("), (".reverse()", ".sort()"), ("colIndex < rowCount", "colIndex !== rowCount")],
    "retryDelay": [("Math.min(", "Math.max("), ("baseDelay * Math.pow", "baseDelay / Math.pow"), ("metrics.observe(", "metrics.forget(")],
    "groupWords": [(".toLowerCase()", ".trimEnd()"), ("sameGroup.push(", "sameGroup.unshift("), ("wordGroups.set(groupKey, sameGroup)", "wordGroups.delete(groupKey)")],
}
TYPES = {
    "OrderLine": ["articleId: string", "quantity: number", "unitPrice: number", "note?: string", "tags: string[]"],
    "SensorReading": ["deviceId: string", "takenAt: Date", "celsius: number", "valid: boolean", "history: Array<number>"],
    "ProfileCard": ["displayName: string", "photoUrl: string | null", "followers: number", "onOpen: (id: string) => void", "badges: Badge[]"],
    "BuildStep": ["command: string", "env: Map<string, string>", "timeoutMs: number", "retries?: number", "state: 'idle' | 'busy' | 'done'"],
    "RouteLeg": ["from: Place", "to: Place", "meters: number", "toll: boolean", "turns: [number, number][]"],
    "Invoice": ["invoiceId: string", "dueOn: Date", "lines: Line[]", "paid: boolean", "customer: Customer", "remarks?: string"],
}
CLASSES = {
    "BasketStore": (["entries: Map<string, number>", "ownerId: string"], [("add", "key: string, count: number", "void", "this.entries.set(key, count);"), ("total", "", "number", "return [...this.entries.values()].reduce((sum, x) => sum + x, 0);"), ("clear", "", "void", "this.entries.clear();")]),
    "AudioClip": (["samples: number[]", "rate: number", "muted: boolean"], [("seconds", "", "number", "return this.samples.length / this.rate;"), ("gain", "factor: number", "void", "this.samples = this.samples.map((x) => x * factor);"), ("mute", "", "void", "this.muted = true;")]),
    "TicketQueue": (["waiting: Ticket[]", "served: number"], [("push", "ticket: Ticket", "number", "return this.waiting.push(ticket);"), ("next", "", "Ticket | undefined", "this.served += 1; return this.waiting.shift();"), ("size", "", "number", "return this.waiting.length;"), ("isIdle", "", "boolean", "return this.waiting.length === 0;")]),
    "GeoFence": (["corners: Point[]", "label: string"], [("contains", "point: Point", "boolean", "return inside(this.corners, point);"), ("area", "", "number", "return areaOf(this.corners);"), ("rename", "label: string", "void", "this.label = label;")]),
}


def _function(name: str, parameters: str, result: str, body: list[str]) -> str:
    return f"export function {name}({parameters}): {result} {{\n" + "\n".join("  " + x for x in body) + "\n}\n"


def _arrow(name: str, parameters: str, result: str, body: list[str]) -> str:
    return f"export const {name} = ({parameters}): {result} => {{\n" + "\n".join("  " + x for x in body) + "\n};\n"


def _renamed(name: str, parameters: str, body: list[str]) -> tuple[str, list[str]]:
    """Parameters and locals under other names; fields, calls and strings stay."""
    declared = re.findall(r"(\w+): ", parameters) + re.findall(r"\b(?:let|const) (\w+)", "\n".join(body))
    for m in re.finditer(r"const \[(\w+), (\w+)\]|\((\w+)\) =>", "\n".join(body)):
        declared += [x for x in m.groups() if x]
    names = {n: f"{'abcdefghijklm'[i % 13]}{i}x" for i, n in enumerate(dict.fromkeys(declared))}
    swap = lambda text: re.sub(r"(?<![\w.])(\w+)", lambda m: names.get(m[1], m[1]), text)
    return swap(parameters), [swap(x) for x in body]


def _interface(name: str, members: list[str]) -> str:
    return f"export interface {name} {{\n" + "\n".join(f"  {m};" for m in members) + "\n}\n"


def _alias(name: str, members: list[str]) -> str:
    return f"export type {name} = {{\n" + "\n".join(f"  {m};" for m in members) + "\n};\n"


def _class(name: str, fields: list[str], methods: list[tuple[str, str, str, str]]) -> str:
    inner = [f"  {f};" for f in fields] + [f"  {n}({p}): {r} {{\n    {b}\n  }}" for n, p, r, b in methods]
    return f"export class {name} {{\n" + "\n".join(inner) + "\n}\n"


def cases() -> Iterator[Case]:
    """All labelled pairs, each of two files of its own."""

    def made(mode: str, seed: str, how: str, left: str, right: str, expected: bool) -> Case:
        return Case(f"{mode}/{seed}/{how}", mode, left, right, expected)

    order = list(FUNCTIONS)
    for i, name in enumerate(order):
        parameters, result, body = FUNCTIONS[name]
        own = _function(name, parameters, result, body)
        p, b = _renamed(name, parameters, body)
        twin = f"{name}Too"
        calls = lambda rows, to=twin, name=name: [x.replace(f"{name}(", f"{to}(") for x in rows]
        yield made("functions", name, "names", own, _function(twin, p, result, calls(b)), True)
        yield made("functions", name, "arrow", own, _arrow(twin, parameters, result, calls(body)), True)
        yield made("functions", name, "untyped", own, _function(twin, re.sub(r": [^,]+(?=,|$)", "", parameters) if "<" not in parameters else parameters, "any", calls(body)), True)
        yield made("functions", name, "comments", own, _function(twin, parameters, result, [y for x in calls(body) for y in ("// step", x)]), True)
        yield made("functions", name, "quotes", own, _function(twin, parameters, result, [x.replace("'", '"') for x in calls(body)]), True)
        for k, (old, new) in enumerate(CHANGES.get(name, [])):
            yield made("functions", name, f"change{k}", own, _function(twin, parameters, result, calls([x.replace(old, new) for x in body])), False)
        for k in (1, 4):
            other = order[(i + k) % len(order)]
            yield made("functions", name, f"other{k}", own, _function(other, *FUNCTIONS[other]), False)
    for i, (name, members) in enumerate(TYPES.items()):
        own = _interface(name, members)
        yield made("types", name, "alias", own, _alias(f"{name}View", members), True)
        yield made("types", name, "order", own, _interface(f"{name}Row", members[::-1]), True)
        yield made("types", name, "spelling", own, _interface(f"{name}Data", [re.sub(r"Array<(\w+)>|(\w+)\[\](?!\[)", lambda m: f"{m[1]}[]" if m[1] else f"Array<{m[2]}>", x) for x in members]), True)
        yield made("types", name, "readonly", own, _interface(f"{name}Copy", [f"readonly {x}" for x in members]), True)
        yield made("types", name, "kinds", own, _interface(f"{name}Flag", [re.sub(r": .*", ": symbol", x) for x in members]), False)
        other = list(TYPES)[(i + 1) % len(TYPES)]
        yield made("types", name, "other", own, _interface(other, TYPES[other]), False)
    for i, (name, (fields, methods)) in enumerate(CLASSES.items()):
        own = _class(name, fields, methods)
        yield made("classes", name, "name", own, _class(f"{name}Two", fields, methods), True)
        yield made("classes", name, "order", own, _class(f"{name}B", fields[::-1], methods[::-1]), True)
        yield made("classes", name, "parameter", own, _class(f"{name}P", fields, [(n, re.sub(r"\b\w+:", "given:", p, count=1), r, re.sub(rf"(?<![.\w]){p.split(':')[0]}\b", "given", b) if p else b) for n, p, r, b in methods]), True)
        other = list(CLASSES)[(i + 1) % len(CLASSES)]
        yield made("classes", name, "other", own, _class(other, *CLASSES[other]), False)
        yield made("classes", name, "statics", own, _class(f"{name}S", [f"static {f}" for f in fields], methods[:1]), False)


def verdicts(spark: SparkSession, options: Options | None = None) -> DataFrame:
    """case_id, mode, expected, found: one analysis of all snippets; a case is found if its two files make a pair."""
    rows = list(cases())
    files = [(f"{c.case_id}/{side}.ts", text) for c in rows for side, text in (("left", c.left), ("right", c.right))]
    df = spark.createDataFrame(files, "file_path string, content string")
    o = options or Options(modes=("functions", "types", "classes"), threshold=0.8, min_lines=3)
    case = lambda side: F.regexp_extract(f"{side}.file_path", "^(.*)/(?:left|right)\\.ts$", 1)
    hits = analyze(df, o).pairs.where((case("left_loc") == case("right_loc")) & (F.col("left_loc.file_path") != F.col("right_loc.file_path")))
    hits = hits.select(case("left_loc").alias("case_id"), "mode").distinct().withColumn("found", F.lit(True))
    labels = spark.createDataFrame([(c.case_id, c.mode, c.expected) for c in rows], "case_id string, mode string, expected boolean")
    return labels.join(hits, ["case_id", "mode"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def confusion(verdict: DataFrame) -> DataFrame:
    """mode, n_cases, true_pos, false_neg, true_neg, false_pos."""
    e, f = F.col("expected"), F.col("found")
    return verdict.groupBy("mode").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(e & f).alias("true_pos"), F.count_if(e & ~f).alias("false_neg"), F.count_if(~e & ~f).alias("true_neg"), F.count_if(~e & f).alias("false_pos"))


def labels_sql() -> str:
    """The confusion matrix of a faultless analysis, from the labels alone."""
    values = ", ".join(f"('{c.case_id}', '{c.mode}', {str(c.expected).lower()})" for c in cases())
    return f"""select mode, count(*) as n_cases, count(*) filter (expected) as true_pos, cast(0 as bigint) as false_neg, count(*) filter (not expected) as true_neg, cast(0 as bigint) as false_pos
from (values {values}) as labels(case_id, mode, expected) group by mode"""
