"""A packed context as Markdown, and the prompts made from it. A package is small: at most as many nodes as were packed."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbograph.operators import score, traverse
from arbograph.operators.graph import Graph
from arbograph.runtime import stored

#: Fixed: what stands before and after the body of each prompt; GOAL stands for the goal.
PROMPTS = {
    "review": (
        "You are a senior PHP code reviewer. Review the following code changes and their potential impact on the codebase.",
        (
            "Review each changed file for correctness, performance, and security issues",
            "Consider the impact on affected nodes listed above",
            "Flag any breaking changes to public interfaces",
            "Suggest improvements with specific code examples",
            "Check for missing error handling, edge cases, and type safety",
        ),
    ),
    "refactor": (
        "You are a senior PHP architect. Help refactor the following code to achieve: GOAL",
        (
            "Analyze the current architecture based on the code above",
            "Propose a refactoring strategy to achieve: GOAL",
            "Identify dependencies that need to be updated",
            "Provide step-by-step migration instructions",
            "Highlight any risks or breaking changes",
        ),
    ),
    "tests": (
        "You are a senior PHP test engineer. Generate comprehensive test coverage for the following code.",
        (
            "Identify test cases for each class/method",
            "Cover happy paths, edge cases, and error conditions",
            "Include integration tests for cross-component interactions",
            "Use PHPUnit conventions",
            "Prioritize tests by risk and business impact",
        ),
    ),
}
#: Fixed: the heading of each prompt's code, and the lines of a node below its heading.
HEADINGS = {"review": "## Affected Code (by relevance)", "refactor": "## Current State", "tests": "## Code to Test"}


@dataclass(frozen=True)
class ContextNode:
    fqcn: str
    type: str
    file: str
    line: int
    score: float
    snippet: str | None


@dataclass(frozen=True)
class ContextPackage:
    nodes: list[ContextNode] = field(default_factory=list)
    n_edges: int = 0
    tokens: int = 0
    changed: list[str] = field(default_factory=list)


def rounded(value: float) -> str:
    """To two places, half away from zero, without zeros at the end."""
    text = str(Decimal(str(value)).quantize(Decimal("0.01"), ROUND_HALF_UP))
    return text.rstrip("0").rstrip(".")


def _code(node: ContextNode) -> list[str]:
    return [] if node.snippet is None else ["```php", node.snippet, "```", ""]


def prompt(kind: str, package: ContextPackage, goal: str = "") -> str:
    """The prompt of a kind of PROMPTS over a package."""
    body: list[str] = []
    if kind == "review":
        body += ["## Changed Files", "", *(f"- {c}" for c in package.changed), ""]
    body += [HEADINGS[kind], ""]
    for n in package.nodes:
        body.append(f"### {n.fqcn}" + (f" (score: {rounded(n.score)})" if kind == "review" else ""))
        body.append(f"Type: {n.type}")
        if kind == "review":
            body.append(f"File: {n.file}:{n.line}")
        if kind == "refactor":
            body.append(f"Relevance score: {rounded(n.score)}")
        body += ["", *_code(n)]
    opening, steps = PROMPTS[kind]
    numbered = [f"{i}. {s}" for i, s in enumerate(steps, 1)]
    return "\n".join([opening.replace("GOAL", goal), "", *body, "## Instructions", "", *(s.replace("GOAL", goal) for s in numbered)])


def package_markdown(package: ContextPackage) -> str:
    out = ["# Context Package", "", f"**Changed:** {', '.join(package.changed)}", f"**Nodes:** {len(package.nodes)}", f"**Edges:** {package.n_edges}", f"**Estimated tokens:** {package.tokens}", ""]
    for n in package.nodes:
        out += [f"## {n.fqcn}", f"**Type:** {n.type}", f"**Score:** {rounded(n.score)}", f"**File:** {n.file}:{n.line}", "", *_code(n)]
    return "\n".join(out)


def build(graph: Graph, changed: list[str], impact: DataFrame, files: DataFrame, nodes: int = 20, tokens: int = 8000) -> ContextPackage:
    """The package of an impact: its nodes ranked by relevance, with snippets of files(file, content), packed into the budget.

    Snippets are cut out only for the first `nodes` nodes of the order, as no others can be packed.
    """
    ranked = score.relevance(graph, impact)
    top = ranked.orderBy(F.desc("score"), "distance", "id").limit(nodes)
    top = stored(top.join(graph.nodes.select("id", "fqcn", "type", "file", "line", "end_line"), "id"), "top")
    cut = score.snippets(top.select("id", "file", "line", "end_line").join(files.select("file", "content"), "file"))
    top = stored(top.join(cut, "id", "left"), "top")
    packed = score.pack(top.select("id", "score", "distance", "snippet"), nodes, tokens)
    rows = packed.join(top, "id").orderBy("place").collect()
    own = graph.nodes.sparkSession.createDataFrame([(r.id,) for r in rows], "id string")
    return ContextPackage([ContextNode(r.fqcn, r.type, r.file, r.line, r.score, r.snippet) for r in rows], graph.induced(own).count() if rows else 0, rows[-1].tokens_after if rows else 0, changed)


def impact_package(graph: Graph, start: str, files: DataFrame, depth: int = 5) -> ContextPackage:
    """build() for the impact of a change of one node."""
    impact = stored(traverse.reached(graph, graph.nodes.sparkSession.createDataFrame([(start,)], "id string"), "incoming", depth), "impact")
    return build(graph, [start], impact, files)
