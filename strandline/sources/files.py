"""Graphs in files: node-link JSON, SQLite, Parquet, and Python source trees."""

from __future__ import annotations

import ast
import json
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.graph import EDGE_SCHEMA, NODE_SCHEMA, PropertyGraph, conform


def read_json(spark: SparkSession, path: str) -> PropertyGraph:
    """A node-link document: {nodes: [...], edges: [...], graph: {...}}."""
    doc = spark.read.option("multiLine", True).json(path)
    return PropertyGraph.of(doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode("edges").alias("e")).select("e.*"))


def write_parquet(g: PropertyGraph, path: str) -> None:
    """Nodes sorted by id and edges by type and source, so that filters prune row groups."""
    g.nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.repartitionByRange("type", "source").sortWithinPartitions("type", "source").write.mode("overwrite").parquet(f"{path}/edges")


def read_parquet(spark: SparkSession, path: str) -> PropertyGraph:
    return PropertyGraph.of(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def _value(x: str):
    try:
        return json.loads(x)
    except ValueError:
        return x


def read_sqlite(spark: SparkSession, path: str) -> PropertyGraph:
    """Tables nodes, edges, node_attrs and edge_attrs (key, JSON value); read on the driver, empty strings as null."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        db.row_factory = sqlite3.Row
        nodes = {r["id"]: {k: r[k] or None for k in r.keys()} for r in db.execute("SELECT * FROM nodes")}
        for r in db.execute("SELECT node_id, key, value FROM node_attrs"):
            if r["node_id"] in nodes:
                nodes[r["node_id"]][r["key"]] = _value(r["value"])
        edges = {r["id"]: dict(r) for r in db.execute("SELECT * FROM edges")}
        for r in db.execute("SELECT edge_id, key, value FROM edge_attrs"):
            if r["edge_id"] in edges:
                key = "evidence" if r["key"] == "source" else r["key"]
                edges[r["edge_id"]][key] = _value(r["value"])

    def rows(items, schema):
        return spark.createDataFrame([tuple(x.get(f.name) for f in schema.fields) for x in items], schema)

    return PropertyGraph(rows(nodes.values(), NODE_SCHEMA), rows(edges.values(), EDGE_SCHEMA))


def write_sqlite(g: PropertyGraph, path: str) -> None:
    """For compatibility: rows go to the driver in turn, none is held longer than it takes to insert it."""
    core = ("id", "type", "name", "display_name", "domain", "docname", "anchor")
    with sqlite3.connect(path) as db:
        for t in ("nodes", "edges", "node_attrs", "edge_attrs"):
            db.execute(f"DROP TABLE IF EXISTS {t}")
        db.execute("CREATE TABLE nodes (" + ", ".join(f"{c} TEXT" + " PRIMARY KEY" * (c == "id") for c in core) + ")")
        db.execute("CREATE TABLE edges (id INTEGER PRIMARY KEY, source TEXT, target TEXT, type TEXT)")
        db.execute("CREATE TABLE node_attrs (node_id TEXT, key TEXT, value TEXT)")
        db.execute("CREATE TABLE edge_attrs (edge_id INTEGER, key TEXT, value TEXT)")
        for r in g.nodes.toLocalIterator():
            d = r.asDict()
            db.execute(f"INSERT INTO nodes VALUES ({', '.join('?' * len(core))})", [d[c] or "" for c in core])
            db.executemany("INSERT INTO node_attrs VALUES (?, ?, ?)", [(d["id"], k, json.dumps(v)) for k, v in d.items() if k not in core and v is not None])
        for i, r in enumerate(g.edges.toLocalIterator()):
            d = r.asDict()
            db.execute("INSERT INTO edges VALUES (?, ?, ?, ?)", [i, d["source"], d["target"], d["type"]])
            db.executemany("INSERT INTO edge_attrs VALUES (?, ?, ?)", [(i, "source" if k == "evidence" else k, json.dumps(v)) for k, v in d.items() if k not in ("source", "target", "type") and v is not None])


def module_name(path: str, root: str) -> str:
    rel = path.split("://", 1)[-1].removeprefix("file:")
    rel = rel[rel.find(root) + len(root) :] if root in rel else rel
    parts = rel.strip("/").removeprefix("src/").removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


def scan_module(path: str, source: bytes, root: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of one Python file: definitions, imports, bases, calls, decorators and markers."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [], []
    module = module_name(path, root)
    test_file = module.rsplit(".", 1)[-1].startswith("test_") or ".tests." in f".{module}."
    nodes, edges, aliases = [], [], {}

    def dotted(x: ast.AST) -> str | None:
        if isinstance(x, ast.Name):
            return aliases.get(x.id, x.id)
        if isinstance(x, ast.Attribute) and (base := dotted(x.value)):
            return f"{base}.{x.attr}"
        return None

    def node(kind: str, name: str, item: ast.AST | None = None) -> str:
        marks = [dotted(d.func if isinstance(d, ast.Call) else d) or "" for d in getattr(item, "decorator_list", [])]
        strings = lambda which: [a.value for d in getattr(item, "decorator_list", []) if isinstance(d, ast.Call) and (dotted(d.func) or "").endswith(which) for a in d.args if isinstance(a, ast.Constant) and isinstance(a.value, str)]
        short = name.rsplit(".", 1)[-1]
        nodes.append({
            "id": f"py:{kind}:{name}", "type": kind, "name": name, "display_name": short, "domain": "py", "file_path": path, "lineno": getattr(item, "lineno", 1), "end_lineno": getattr(item, "end_lineno", None),
            "decorator_lineno": min((d.lineno for d in getattr(item, "decorator_list", [])), default=None), "is_test": test_file and kind in ("function", "method") and short.startswith("test"), "in_test_file": test_file,
            "decorators": marks, "verifies": strings(".verifies"), "catches": strings(".catches"), "vv_level": next((m.rsplit(".", 1)[-1].upper() for m in marks if m.rsplit(".", 1)[-1].lower() in ("l0", "l1", "l2", "l3")), None),
        })
        return nodes[-1]["id"]

    def edge(source: str, target: str, kind: str, **more) -> None:
        edges.append({"source": source, "target": target, "type": kind, **more})

    def visit(body: list, owner: str, scope: str, in_class: str | None, typing_only: bool = False) -> None:
        for x in body:
            if isinstance(x, ast.Import):
                for a in x.names:
                    aliases[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                    edge(root_id, f"py:module:{a.name}", "imports", lineno=x.lineno, type_checking=typing_only)
            elif isinstance(x, ast.ImportFrom):
                base = module.split(".")
                package = base[: len(base) - x.level + (1 if path.endswith("__init__.py") else 0)] if x.level else []
                source_module = ".".join([*package, *([x.module] if x.module else [])])
                edge(root_id, f"py:module:{source_module}", "imports", lineno=x.lineno, type_checking=typing_only)
                aliases.update({a.asname or a.name: f"{source_module}.{a.name}" for a in x.names})
            elif isinstance(x, ast.ClassDef):
                me = node("class", f"{scope}.{x.name}", x)
                edge(owner, me, "contains")
                for b in x.bases:
                    if name := dotted(b.value if isinstance(b, ast.Subscript) else b):
                        edge(me, f"py:unresolved:{name}", "inherits")
                visit(x.body, me, f"{scope}.{x.name}", f"{scope}.{x.name}")
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                me = node("method" if in_class else "function", f"{scope}.{x.name}", x)
                edge(owner, me, "contains")
                for arg in (*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs):
                    if arg.annotation is not None and (name := dotted(arg.annotation)):
                        edge(me, f"py:unresolved:{name}", "type_uses", param=arg.arg)
                for c in ast.walk(x):
                    if isinstance(c, ast.Call) and (name := dotted(c.func)):
                        edge(me, f"py:unresolved:{in_class + name[4:] if in_class and name.startswith('self.') else name}", "calls", lineno=c.lineno)
                visit([s for s in x.body if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))], me, f"{scope}.{x.name}", None)
            elif isinstance(x, (ast.If, ast.Try)):
                only = isinstance(x, ast.If) and (dotted(x.test) or "").endswith("TYPE_CHECKING")
                visit(x.body, owner, scope, in_class, typing_only or only)
                visit(x.orelse, owner, scope, in_class, typing_only)
            elif isinstance(x, (ast.Assign, ast.AnnAssign)):
                for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    if isinstance(t, ast.Name):
                        edge(owner, node("attribute" if in_class else "data", f"{scope}.{t.id}", x), "contains")

    root_id = node("module", module)
    visit(tree.body, root_id, module, None)
    return nodes, edges


def analyze_directory(spark: SparkSession, folder: str) -> PropertyGraph:
    """A Python source tree as a graph, one task row a file; vendored folders are skipped; call targets are resolved by name."""
    from strandline.operators.resolve import reconcile

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(folder).filter(~F.col("path").rlike(r"/(\.venv|venv|node_modules|site-packages|build|\.git)/")).select("path", "content")
    root = folder.split("://", 1)[-1].rstrip("/")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [scan_module(p, bytes(c), root) for p, c in zip(frame["path"], frame["content"])]
            yield pd.DataFrame({"n": [json.dumps(n) for n, _ in found], "e": [json.dumps(e) for _, e in found]})

    rows = files.mapInPandas(scan, "n string, e string")
    part = lambda c, schema: rows.select(F.explode(F.from_json(c, F.lit(f"array<{schema.simpleString()}>"))).alias("x")).select("x.*")
    return reconcile(PropertyGraph(part("n", NODE_SCHEMA), part("e", EDGE_SCHEMA)).with_phantoms())


def read_registry(spark: SparkSession, rows: list[dict], g: PropertyGraph) -> DataFrame:
    """Declared edges (source, target, type) of a parsed registry; those with an unknown end are skipped, those that exist are not repeated."""
    declared = conform(spark.createDataFrame([(r["source"], r["target"], r["type"], "registry", float(r.get("confidence", 1.0))) for r in rows], "source string, target string, type string, evidence string, confidence double"), EDGE_SCHEMA)
    known = g.nodes.select("id")
    kept = declared.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept.join(g.edges.select("source", "target", "type"), ["source", "target", "type"], "left_anti").select(*EDGE_SCHEMA.fieldNames())
