"""Prompts over a package, byte by byte, and packages of an impact."""

import pytest

from arbograph.operators.graph import Graph
from arbograph.sources import prompts
from arbograph.sources.prompts import ContextNode, ContextPackage

PACKAGE = ContextPackage([ContextNode("App\\Foo\\Bar", "file", "src/Foo/Bar.php", 10, 0.876, "class Bar {\n    public int $x = 1;\n}")], 0, 100, ["src/Foo/Bar.php", "src/Foo/Baz.php"])
CODE = "```php\nclass Bar {\n    public int $x = 1;\n}\n```\n"
REVIEW = f"""You are a senior PHP code reviewer. Review the following code changes and their potential impact on the codebase.

## Changed Files

- src/Foo/Bar.php
- src/Foo/Baz.php

## Affected Code (by relevance)

### App\\Foo\\Bar (score: 0.88)
Type: file
File: src/Foo/Bar.php:10

{CODE}
## Instructions

1. Review each changed file for correctness, performance, and security issues
2. Consider the impact on affected nodes listed above
3. Flag any breaking changes to public interfaces
4. Suggest improvements with specific code examples
5. Check for missing error handling, edge cases, and type safety"""
REFACTOR = f"""You are a senior PHP architect. Help refactor the following code to achieve: extract a service

## Current State

### App\\Foo\\Bar
Type: file
Relevance score: 0.88

{CODE}
## Instructions

1. Analyze the current architecture based on the code above
2. Propose a refactoring strategy to achieve: extract a service
3. Identify dependencies that need to be updated
4. Provide step-by-step migration instructions
5. Highlight any risks or breaking changes"""
TESTS = f"""You are a senior PHP test engineer. Generate comprehensive test coverage for the following code.

## Code to Test

### App\\Foo\\Bar
Type: file

{CODE}
## Instructions

1. Identify test cases for each class/method
2. Cover happy paths, edge cases, and error conditions
3. Include integration tests for cross-component interactions
4. Use PHPUnit conventions
5. Prioritize tests by risk and business impact"""


@pytest.mark.parametrize("kind,goal,text", [("review", "", REVIEW), ("refactor", "extract a service", REFACTOR), ("tests", "", TESTS)])
def test_prompts(kind, goal, text):
    assert prompts.prompt(kind, PACKAGE, goal) == text


def test_an_empty_package():
    text = prompts.prompt("review", ContextPackage())
    assert "{{" not in text and text.startswith("You are a senior PHP code reviewer.") and "## Affected Code (by relevance)\n\n## Instructions" in text
    assert prompts.package_markdown(ContextPackage()).startswith("# Context Package\n\n**Changed:** \n**Nodes:** 0\n")


@pytest.mark.parametrize("value,text", [(0.876, "0.88"), (0.125, "0.13"), (2.0, "2"), (3.333333, "3.33"), (10.0, "10"), (0.5, "0.5")])
def test_rounding(value, text):
    assert prompts.rounded(value) == text


def test_package_of_an_impact(spark):
    nodes = [(f"class:{x}", "service", x, x, f"{x}.php", 2, 3, "M", "{}", False) for x in "ABC"]
    g = Graph(spark.createDataFrame(nodes, "id string, type string, fqcn string, name string, file string, line int, end_line int, module string, metadata string, is_placeholder boolean"), spark.createDataFrame([("class:B", "class:A", "calls", "{}"), ("class:C", "class:B", "calls", "{}")], "source_id string, target_id string, type string, metadata string"))
    files = spark.createDataFrame([("B.php", "l1\nl2\nl3\nl4"), ("C.php", None)], "file string, content string")
    package = prompts.impact_package(g, "class:A", files)
    assert [(n.fqcn, n.score, n.snippet) for n in package.nodes] == [("B", 8.0, "l1\nl2\nl3\nl4"), ("C", 4.0, None)]
    assert (package.n_edges, package.tokens, package.changed) == (1, 2 + 50 + 50, ["class:A"])
    assert "**Score:** 8\n**File:** B.php:2\n\n```php\nl1" in prompts.package_markdown(package)
    assert prompts.impact_package(g, "class:none", files).nodes == []
