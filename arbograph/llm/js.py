"""ECMAScript 2022 modules: tokens and grammar."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from arbograph.sources.gll import END, Grammar

#: Fixed: words that are reserved in a module.
RESERVED = "await break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in instanceof interface let new null package private protected public return static super switch this throw true try typeof var void while with yield".split()
#: Fixed: words that mean something at some places and are names elsewhere.
CONTEXTUAL = "as async from get of set".split()
BINARY = frozenset("** * / % << >> >>> < > <= >= == != === !== & ^ | && || ??".split())
ASSIGN = frozenset("+= -= *= /= %= **= <<= >>= >>>= &= ^= |= &&= ||= ??=".split())

#: ~ stands for the two kinds of statements: outside functions, and (R) inside, where return is allowed.
_STATEMENTS = r"""
Item~: Declaration | Statement~ ;
Block~: '{' Item~* '}' ;
Statement~: Block~ | ';' | 'var' Bindings Semi | 'if' '(' Expr ')' Statement~ ('else' Statement~)? | 'while' '(' Expr ')' Statement~ | 'do' Statement~ 'while' '(' Expr ')' ';'?
 | 'for' 'await'? '(' ForHead ')' Statement~ | 'switch' '(' Expr ')' '{' Case~* '}' | 'break' Jump | 'continue' Jump | 'throw' SAMELINE Expr Semi
 | 'try' Block~ (Catch~ Finally~? | Finally~) | 'debugger' Semi | Id ':' Statement~ | NOSTATEMENT Expr Semi RETURN ;
Case~: 'case' Expr ':' Item~* | 'default' ':' Item~* ;
Catch~: 'catch' ('(' Target ')')? Block~ ;
Finally~: 'finally' Block~ ;
"""
GRAMMAR = (
    r"""
Start: ModuleItem* END ;
ModuleItem: Item | Import | Export ;
Import: 'import' STRING Semi | 'import' ImportClause 'from' STRING Semi ;
ImportClause: Id (',' (Star | Named))? | Star | Named ;
Star: '*' 'as' Id ;
Named: '{' Specifiers '}' ;
Specifiers: | Specifier SpecifierRest ;
SpecifierRest: | ',' Specifiers ;
Specifier: ModuleName ('as' ModuleName)? ;
ModuleName: Word | STRING ;
Export: 'export' 'default' Default | 'export' '*' ('as' ModuleName)? 'from' STRING Semi | 'export' Named ('from' STRING)? Semi | 'export' 'var' Bindings Semi | 'export' Declaration ;
Default: 'function' '*'? Id? FunctionRest | 'async' SAMELINE 'function' '*'? Id? FunctionRest | Class | NOFUNCTION Assign Semi ;
Semi: ';' | BREAK ;
Declaration: 'let' Bindings Semi | 'const' ConstBinding (',' ConstBinding)* Semi | 'function' '*'? Id FunctionRest | 'async' SAMELINE 'function' '*'? Id FunctionRest | 'class' Id ClassRest ;
Bindings: Binding (',' Binding)* ;
Binding: Id ('=' Assign)? | Pattern '=' Assign ;
ConstBinding: Target '=' Assign ;
Target: Id | Pattern ;
Pattern: '{' PatternProps '}' | '[' PatternItems ']' ;
PatternProps: | PatternProp PatternPropRest ;
PatternPropRest: | ',' PatternProps ;
PatternProp: PropName ':' Target ('=' Assign)? | Id ('=' Assign)? | '...' Target ;
PatternItems: PatternItem? (',' PatternItem?)* ;
PatternItem: Target ('=' Assign)? | '...' Target ;
ForHead: ForInit? ';' Expr? ';' Expr? | ForKind Target ForIn | PatternTarget ForIn ;
ForKind: 'var' | 'let' | 'const' ;
ForInit: 'var' Bindings | 'let' Bindings | 'const' ConstBinding (',' ConstBinding)* | Expr ;
ForIn: 'of' Assign | 'in' Expr ;
Jump: SAMELINE Id Semi | Semi ;
Return: 'return' ReturnRest ;
ReturnRest: SAMELINE Expr Semi | Semi ;
FunctionRest: '(' Params ')' BlockR ;
Params: | Param ParamsRest | '...' Target ;
ParamsRest: | ',' Params ;
Param: Target ('=' Assign)? ;
Class: 'class' Id? ClassRest ;
ClassRest: ('extends' Left)? '{' Element* '}' ;
Element: ';' | 'static' BlockR | 'static'? ElementRest ;
ElementRest: Method | ElementName ('=' Assign)? Semi ;
Method: 'get' ElementName '(' ')' BlockR | 'set' ElementName '(' Param ')' BlockR | '*' ElementName FunctionRest | 'async' SAMELINE '*'? ElementName FunctionRest | ElementName FunctionRest ;
ElementName: PropName | PRIVATE ;
PropName: Word | STRING | NUMBER | '[' Assign ']' ;
Expr: Assign (',' Assign)* ;
Assign: Simple | Arrow | AssignPattern '=' Assign | 'yield' YieldRest ;
YieldRest: | SAMELINE Assign | SAMELINE '*' Assign ;
Arrow: ('async' SAMELINE)? ArrowHead '=>' ArrowBody ;
ArrowHead: ARROWNAME | ARROWOPEN Params ')' ;
ArrowBody: BlockR | NOBRACE Assign ;
Simple: Left LeftRest | Literal LiteralRest Conditional | Prefix Unary Conditional | PRIVATE 'in' Unary Conditional ;
LeftRest: '=' Assign | ASSIGN Assign | PostOp Conditional ;
LiteralRest: (Suffix+ LiteralTail)? ;
LiteralTail: | '=' Assign | ASSIGN Assign | SAMELINE UPDATE ;
Conditional: (BinOp Unary)* ('?' Assign ':' Assign)? ;
BinOp: BINOP | '+' | '-' | '*' | 'in' | 'instanceof' ;
Unary: Prefix Unary | Left PostOp | Literal Suffix* | PRIVATE ;
PostOp: | SAMELINE UPDATE ;
Prefix: '+' | '-' | '!' | '~' | UPDATE | 'typeof' | 'void' | 'delete' | 'await' ;
Left: Primary Suffix* ;
Suffix: '.' Word | '.' PRIVATE | '?.' Optional | '[' Expr ']' | Args | Template ;
Optional: Word | PRIVATE | '[' Expr ']' | Args ;
Args: '(' ArgList ')' ;
ArgList: | Arg ArgRest ;
ArgRest: | ',' ArgList ;
Arg: Assign | '...' Assign ;
Literal: NUMBER | STRING | REGEX | 'true' | 'false' | 'null' ;
Primary: Id | 'this' | 'super' | '[' Items ']' | '{' Props '}' | 'function' '*'? Id? FunctionRest | 'async' SAMELINE 'function' '*'? Id? FunctionRest | Class | '(' Expr ')' | Template | New | 'import' Args | 'import' '.' Word ;
New: 'new' NewRest ;
NewRest: '.' Word | (Primary | Literal) NewSuffix* Args? ;
NewSuffix: '.' Word | '.' PRIVATE | '[' Expr ']' | Template ;
Items: Arg? (',' Arg?)* ;
Props: | Prop PropRest ;
PropRest: | ',' Props ;
Prop: PropName ':' Assign | Id | Method | '...' Assign ;
PatternTarget: AssignPattern | Left ;
AssignPattern: '{' TargetProps '}' | '[' TargetItems ']' ;
TargetProps: | TargetProp TargetPropRest ;
TargetPropRest: | ',' TargetProps ;
TargetProp: PropName ':' PatternTarget ('=' Assign)? | Id ('=' Assign)? | '...' PatternTarget ;
TargetItems: TargetItem? (',' TargetItem?)* ;
TargetItem: PatternTarget ('=' Assign)? | '...' PatternTarget ;
Template: TEMPLATE | THEAD Expr (TMIDDLE Expr)* TTAIL ;
Id: NAME | CONTEXTUAL ;
Word: Id | ARROWNAME | RESERVED ;
"""
    + _STATEMENTS.replace("~", "").replace(" RETURN", "")
    + _STATEMENTS.replace("~", "R").replace(" RETURN", " | Return")
)
_GRAMMAR = GRAMMAR.replace("NAME | CONTEXTUAL", " | ".join(["NAME", *(f"'{w}'" for w in CONTEXTUAL)])).replace("ARROWNAME | RESERVED", " | ".join(["ARROWNAME", *(f"'{w}'" for w in RESERVED)]))
JS = Grammar(_GRAMMAR, "Start", {"NOSTATEMENT": ("{", "function", "class"), "NOFUNCTION": ("function", "class"), "NOBRACE": ("{",)})
K = JS.kinds
ERROR = len(K)

_ID = r"(?:[A-Za-z_$\x80-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_CODE = re.compile(
    rf"""
    (?P<nl>[\t\v\f \xa0﻿  -   　]*[\r\n  ]\s*)
  | (?P<ws>[\t\v\f \xa0﻿  -   　]+)
  | (?P<comment>//[^\r\n  ]*|/\*[\s\S]*?\*/)
  | (?P<name>{_ID})
  | (?P<num>(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:0|[1-9]\d*(?:_\d+)*)n|(?:(?:0|[1-9]\d*(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?)(?![\w$\\]))
  | (?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')
  | (?P<template>`(?:[^`\\$]|\\[\s\S]|\$(?!\{{))*(?:`|\$\{{))
  | (?P<private>\#{_ID})
  | (?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:;,.()\[\]{{}}])
    """,
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n  ]|\\[^\r\n  ]|\[(?:[^\]\\\r\n  ]|\\[^\r\n  ])*\])+/[dgimsuvy]*(?![\w$])")
_MIDDLE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{)")
_OCTAL = re.compile(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|0\d)")
_KIND_OF_WORD = {w: K[w] for w in [*RESERVED, *CONTEXTUAL]}
_KIND_OF_OP = {o: K["BINOP"] for o in BINARY} | {o: K["ASSIGN"] for o in ASSIGN} | {o: K[o] for o in "+ - * ! ~ = => ? ?. : ; , . ... ( ) [ ] { }".split()} | {"++": K["UPDATE"], "--": K["UPDATE"]}
#: After these a slash begins a regular expression.
_BEFORE_REGEX = {K[k] for k in "BINOP ASSIGN + - * ! ~ = => ? : ; , ... ( [ { } return typeof instanceof in new delete void throw case do else yield await TMIDDLE THEAD default".split() if k in K}
_PAREN_WORDS = {K[k] for k in ("if", "while", "for", "with") if k in K}


@dataclass
class Tokens:
    kinds: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    fresh: list[bool] = field(default_factory=list)
    broken: bool = False


def tokens(text: str) -> Tokens:
    """Tokens of a module; reading stops at what is no token, which is of kind ERROR."""
    out = Tokens()
    kinds, starts, fresh = out.kinds, out.starts, out.fresh
    at, size, new = 0, len(text), True
    match = _CODE.match
    if text.startswith("#!"):
        at = (re.compile(r"[^\r\n  ]*").match(text) or [""]).end()
    #: of open brackets: (index of the token, whether a regular expression may follow its end, whether it is a template's)
    opens: list[tuple[int, bool, bool]] = []
    regex = True

    def add(kind: int, a: int) -> None:
        nonlocal new
        kinds.append(kind)
        starts.append(a)
        fresh.append(new)
        new = False

    close_paren, dot, optional = K[")"], K["."], K["?."]
    while at < size:
        if text[at] == "/" and regex and (m := _REGEX.match(text, at)):
            add(K["REGEX"], at)
            regex, at = False, m.end()
            continue
        m = match(text, at)
        if not m:
            out.broken = True
            add(ERROR, at)
            break
        group, end = m.lastgroup, m.end()
        if group == "nl":
            new = True
        elif group == "ws":
            pass
        elif group == "comment":
            new = new or m[0][1] == "*" and any(c in m[0] for c in "\r\n  ")
        elif group == "name":
            word = m[0]
            kind = _KIND_OF_WORD.get(word, K["NAME"])
            if kinds and kinds[-1] in (dot, optional):
                kind = K["NAME"]
                regex = False
            else:
                regex = kind in _BEFORE_REGEX
            add(kind, at)
        elif group == "num" or group == "str":
            if group == "str" and "\\" in m[0] and _OCTAL.search(m[0]):
                out.broken = True
                add(ERROR, at)
                break
            add(K["NUMBER" if group == "num" else "STRING"], at)
            regex = False
        elif group == "template":
            if m[0][-1] == "`" and len(m[0]) > 1:
                add(K["TEMPLATE"], at)
                regex = False
            else:
                opens.append((len(kinds), False, True))
                add(K["THEAD"], at)
                regex = True
        elif group == "private":
            add(K["PRIVATE"], at)
            regex = False
        else:
            op = m[0]
            if op == "}" and opens and opens[-1][2]:
                m = _MIDDLE.match(text, end)
                if not m:
                    out.broken = True
                    add(ERROR, at)
                    break
                end = m.end()
                tail = m[0][-1] == "`"
                add(K["TTAIL" if tail else "TMIDDLE"], at)
                regex = not tail
                if tail:
                    opens.pop()
                at = end
                continue
            if op == "=>":
                if kinds and kinds[-1] == close_paren and closed is not None:
                    kinds[closed] = K["ARROWOPEN"]
                elif kinds and (kinds[-1] == K["NAME"] or kinds[-1] in _CONTEXT):
                    kinds[-1] = K["ARROWNAME"]
            if op in "([{" and len(op) == 1:
                if op == "(":
                    after = bool(kinds) and kinds[-1] in _PAREN_WORDS
                elif op == "{":
                    # A brace where an operand may stand opens an object, after which a slash divides; else a block.
                    after = not (kinds and regex and kinds[-1] not in _BLOCK_BEFORE)
                else:
                    after = False
                opens.append((len(kinds), after, False))
                add(_KIND_OF_OP[op], at)
                regex = True
            elif op in ")]}":
                closed, after = None, op == "}"
                if opens and not opens[-1][2]:
                    closed, after, _ = opens.pop()
                add(_KIND_OF_OP[op], at)
                regex = after
            else:
                add(_KIND_OF_OP[op], at)
                regex = op not in ("++", "--") or regex
        at = end
    add(K[END], size)
    return out


_CONTEXT = {K[w] for w in CONTEXTUAL}
_BLOCK_BEFORE = {K[k] for k in (";", "{", "}", "=>", ":", "do", "else")}
