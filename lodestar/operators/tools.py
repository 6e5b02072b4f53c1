"""The tool surface: six tools over JSON-RPC, each a DataFrame query whose few rows become JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import deadcode, graph, paths, search
from lodestar.operators.calls import Config, Model, pooled

#: fixed values of the protocol
PROTOCOL, SERVER = "2024-11-05", "lodestar"
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INTERNAL_ERROR = -32700, -32600, -32601, -32603
CHUNK = 3
#: callers and callees that an answer lists; their totals are always told
NEIGHBOURS = 200


def tool(name: str, description: str, required: dict[str, str], optional: dict[str, str] | None = None) -> dict:
    kinds = {**required, **(optional or {})}
    return {"name": name, "description": description, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in kinds.items()}, "required": list(required)}}


TOOLS = [
    tool("get_symbol_context", "A symbol with its callers and callees", {"symbolId": "string"}, {"limit": "number"}),
    tool("trace_call_path", "The shortest way from one symbol to another", {"fromSymbol": "string", "toSymbol": "string"}),
    tool("search_codebase_symbols", "Ranked symbols for a query", {"query": "string"}, {"limit": "number"}),
    tool("get_dead_code_report", "Symbols that nothing refers to", {}, {"limit": "number"}),
    tool("call_local_llm", "One prompt to the attached model", {"prompt": "string"}, {"model": "string", "endpoint": "string"}),
    tool("batch_local_llm", "Several prompts to the attached model", {"prompts": "array"}, {"model": "string", "endpoint": "string"}),
]


def context_markdown() -> Column:
    """A symbol as a Markdown fragment."""
    return F.concat(F.lit("### "), "name", F.lit(" ("), "kind", F.lit(")\n- file: "), "file_path", F.when(F.col("return_type").isNotNull(), F.concat(F.lit("\n- returns: "), "return_type")).otherwise(F.lit("")), F.when(F.col("summary").isNotNull(), F.concat(F.lit("\n- "), "summary")).otherwise(F.lit("")))


def trace_steps(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, node, next_kind): the nodes of a path with the kind of the edge that leaves each."""
    nodes = found.select(F.posexplode("node_ids").alias("step", "node"))
    kinds = found.select(F.posexplode("edge_ids").alias("s", "e")).join(edges.select("id", "kind").distinct(), F.col("e") == F.col("id")).select("s", F.col("kind").alias("next_kind"))
    return nodes.join(kinds, F.col("step") == F.col("s"), "left").select("step", "node", "next_kind")


def batch_chunks(prompts: DataFrame, size: int = CHUNK) -> DataFrame:
    """``prompts(index, prompt)`` with the number of the chunk that runs them together."""
    return prompts.withColumn("chunk", F.floor(F.col("index") / size))


def run_batch(prompts: DataFrame, model: Model, size: int = CHUNK, config: Config = Config()) -> DataFrame:
    """(index, output, error): ``size`` calls at a time; a prompt that fails or hangs keeps its index and its error."""

    def call(batches: Iterable) -> Iterator:  # noqa: ANN001
        for pdf in batches:
            said = pooled(model, list(pdf["prompt"]), config.updated(concurrency=size))
            yield pdf.assign(output=[a for a, _ in said], error=[e for _, e in said])[["index", "output", "error"]]

    return prompts.select("index", "prompt").mapInPandas(call, "index long, output string, error string")


@dataclass
class Server:
    """Answers JSON-RPC requests over one graph; ``model`` is any callable from prompts to answers."""

    nodes: DataFrame
    edges: DataFrame
    usages: DataFrame | None = None
    model: Model | None = None
    config: Config = Config()

    def execute(self, name: str, args: dict) -> dict:
        if name == "get_symbol_context":
            node = str(args.get("symbolId", ""))
            own = self.nodes.where(F.col("id") == node).select("id", "name", "kind", "file_path", context_markdown().alias("markdown")).first()
            if own is None:
                return {"error": f"Symbol not found: {node}"}
            near, most = graph.ego_neighbors(self.nodes, self.edges, node), int(args.get("limit") or NEIGHBOURS)
            totals = {r["direction"]: r["count"] for r in near.groupBy("direction").count().collect()}
            side = {d: [r.asDict() for r in near.where(F.col("direction") == d).orderBy("edge_id").limit(most).collect()] if d in totals else [] for d in ("in", "out")}
            return {"symbol": own.asDict(), "callers": side["in"], "callees": side["out"], "totalCallers": totals.get("in", 0), "totalCallees": totals.get("out", 0)}
        if name == "trace_call_path":
            found = paths.find_path(self.nodes, self.edges, str(args.get("fromSymbol", "")), str(args.get("toSymbol", "")))
            row = found.first()
            if not row["found"]:
                return {"found": False, "message": row["message"]}
            steps = [r.asDict() for r in trace_steps(found, self.edges).orderBy("step").collect()]
            return {"found": True, "totalHops": row["total_hops"], "path": " -> ".join(row["node_ids"]), "steps": steps}
        if name == "search_codebase_symbols":
            rows = search.search(self.nodes, str(args.get("query", "")), int(args.get("limit") or 10)).select("id", "name", "kind", "score", "reason").collect()
            return {"totalMatches": len(rows), "results": [r.asDict() for r in rows]}
        if name == "get_dead_code_report":
            dead = deadcode.detect(self.nodes, self.edges, self.usages)
            return {"totalCandidates": dead.count(), "candidates": [r.asDict() for r in dead.orderBy("node_id").limit(int(args.get("limit") or 20)).collect()]}
        if name in ("call_local_llm", "batch_local_llm"):
            if self.model is None:
                return {"error": "no model is attached"}
            prompts = [str(args.get("prompt", ""))] if name == "call_local_llm" else [str(p) for p in args.get("prompts", [])]
            rows = run_batch(self.nodes.sparkSession.createDataFrame(list(enumerate(prompts)), "index long, prompt string"), self.model, config=self.config).orderBy("index").collect()
            return {"response": rows[0]["output"]} if name == "call_local_llm" else {"results": [r.asDict() for r in rows]}
        return {"error": f"Unknown tool: {name}"}

    def handle(self, request: dict) -> dict | None:
        """The response to a request; notifications have none."""
        if request.get("id") is None or str(request.get("method", "")).startswith("notifications/"):
            return None
        method, params = request.get("method"), request.get("params") or {}
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": SERVER, "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": TOOLS}
        elif method == "tools/call":
            answer = self.execute(str(params.get("name", "")), params.get("arguments") or {})
            result = {"content": [{"type": "text", "text": json.dumps(answer, ensure_ascii=False)}], "isError": "error" in answer}
        else:
            return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": METHOD_NOT_FOUND, "message": f"Method not found: {method}"}}
        return {"jsonrpc": "2.0", "id": request["id"], "result": result}

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        """One JSON answer per request line; blank lines are skipped."""
        for line in lines:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
            except ValueError:
                yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "Parse error"}})
                continue
            answer = self.handle(request)
            if answer is not None:
                yield json.dumps(answer, ensure_ascii=False)


def expand_keywords(answer: str) -> Sequence[str]:
    """A model's list of keywords: any separator, lower case, longer than one letter, distinct."""
    words = [w.lower() for w in answer.replace(",", " ").replace("，", " ").replace("、", " ").replace(";", " ").replace("|", " ").split()]
    return list(dict.fromkeys(w for w in words if len(w) > 1))
