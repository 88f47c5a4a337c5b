"""Pipelines of named operators: JSON lists of steps, composed lazily. Nothing runs until a result is asked for."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from .registry import create, operator


@dataclass
class Pipeline:
    """Steps {"module", "params", "inputs", "output"}: inputs and output name entries of a workspace, so steps hand over DataFrames, not files."""

    steps: list[dict] = field(default_factory=list)

    def add(self, module: str, inputs: list[str], output: str, **params) -> Pipeline:
        create(module)
        self.steps.append({"module": module, "params": params, "inputs": inputs, "output": output})
        return self

    def run(self, workspace: dict) -> dict:
        """The workspace with every step's output. A failing step names itself."""
        out = dict(workspace)
        for k, step in enumerate(self.steps):
            try:
                args = [out[n] if isinstance(n, str) else [out[m] for m in n] for n in step.get("inputs", [])]
                out[step.get("output", f"step{k}")] = create(step["module"])(*args, **step.get("params", {}))
            except Exception as e:
                raise RuntimeError(f"Step {k} ({step['module']}) failed: {e}") from e
        return out

    def save(self) -> str:
        return json.dumps(self.steps, indent=2)

    @staticmethod
    def load(text: str) -> Pipeline:
        return Pipeline(json.loads(text))


operator("MACROMODELER", "gis", "")(Pipeline)
operator("RUNMACRO", "gis", "text workspace")(lambda text, workspace: Pipeline.load(text).run(workspace))
