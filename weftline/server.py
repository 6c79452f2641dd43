"""Tool server: a JSON object a line in, one out.

Requests are {"id", "tool", "arguments"}; answers {"id", "ok": true, "result"} or the error envelope with the id.
"""

from __future__ import annotations

import json
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from . import api, session


class Server:
    def __init__(self, spark: SparkSession, root: str):
        self.w = api.Workspace(spark, root)

    def tools(self) -> dict:
        w = self.w
        return {
            "index": lambda op="build", force=False: w.index_.stats() if op == "status" else w.index(force or op == "rebuild"),
            "find_symbol": lambda query, scoped=False, limit=20: w.symbol(query, scoped, limit),
            "call_graph": lambda symbol, direction="callers", depth=1: w.calls(symbol, direction),
            "analyze": lambda op="dead-code": w.analyze(op),
            "search": lambda query, limit=10: w.search(query, limit),
            "get_context": lambda file, line, max_tokens=4000: w.context(file, line, max_tokens),
            "intervene": lambda name, file, signature=None: w.intervene(name, file, signature),
            "topology": lambda op="pagerank", path=None, max=20: w.topology(op, path, max),
        }

    def answer(self, request: dict) -> dict:
        try:
            tool = self.tools().get(request.get("tool"))
            if tool is None:
                raise ValueError(f"unknown tool {request.get('tool')}")
            return {"id": request.get("id"), "ok": True, "result": tool(**request.get("arguments", {}))}
        except Exception as e:  # an answer for every request
            return {"id": request.get("id"), **api.envelope(e)}

    def serve(self, lines: TextIO, out: TextIO) -> None:
        for line in lines:
            if line.strip():
                try:
                    request = json.loads(line)
                except ValueError as e:
                    r = {"id": None, **api.envelope(e)}
                else:
                    r = self.answer(request)
                print(json.dumps(r, default=str), file=out, flush=True)


if __name__ == "__main__":
    Server(session.build(), sys.argv[1] if len(sys.argv) > 1 else ".").serve(sys.stdin, sys.stdout)
