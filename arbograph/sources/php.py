"""PHP 8.4: tokens and grammar."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from arbograph.sources.gll import END, Grammar

#: Fixed: the reserved words of PHP 8.4.
KEYWORDS = frozenset(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile eval exit extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield".split()
)
#: Fixed: words that stand for one kind of token.
SAME = {"die": "exit", "include": "PREFIX", "include_once": "PREFIX", "require": "PREFIX", "require_once": "PREFIX", "print": "PREFIX", "clone": "PREFIX", "throw": "PREFIX", "and": "BINOP", "or": "BINOP", "xor": "BINOP"}
#: Fixed: operators that only stand between two operands.
BINARY = frozenset("* / % ** . << >> < <= > >= == != <> === !== <=> ^ && || ??".split())
ASSIGN = frozenset("+= -= *= /= .= %= **= &= |= ^= <<= >>= ??=".split())

GRAMMAR = r"""
Start: Top* END ;
Top: Statement | 'namespace' Namespace | 'use' UseItem (',' UseItem)* ';' | 'const' Constant (',' Constant)* ';' | Attributes 'const' Constant (',' Constant)* ';' | '__halt_compiler' '(' ')' ';' ;
Namespace!: AnyName ';' | AnyName? '{' NamespaceItem* '}' ;
NamespaceItem: Statement | 'use' UseItem (',' UseItem)* ';' | 'const' Constant (',' Constant)* ';' ;
AnyName: NAME | QNAME ;
UseItem!: UseKind? AnyName UseRest? ;
UseKind: 'function' | 'const' ;
UseRest: 'as' NAME | GROUP '{' GroupItem (',' GroupItem)* TrailComma '}' ;
TrailComma: | TRAILCOMMA ;
GroupItem!: UseKind? AnyName ('as' NAME)? ;
Constant: Ident '=' Expr ;
Block: '{' Statement* '}' ;
Statement: Block | 'if' '(' Expr ')' If | 'while' '(' Expr ')' While | 'do' Statement 'while' '(' Expr ')' ';'
 | 'for' '(' Exprs? ';' Exprs? ';' Exprs? ')' For | 'foreach' '(' Expr 'as' Each ('=>' Each)? ')' Foreach
 | 'switch' '(' Expr ')' Switch | 'break' Expr? ';' | 'continue' Expr? ';' | 'return' Expr? ';'
 | 'global' SimpleVar (',' SimpleVar)* ';' | 'static' StaticVar (',' StaticVar)* ';' | 'echo' Exprs ';' | HTML
 | 'unset' '(' Expr UnsetRest ')' ';' | 'try' Block Catch* Finally? | 'declare' '(' DeclareItem (',' DeclareItem)* ')' Declare
 | ';' | 'goto' NAME ';' | NAME ':' | Expr ';' | Function | Class | Attributes Function | Attributes Class ;
UnsetRest: | ',' | ',' Expr UnsetRest ;
If: ':' Statement* ('elseif' '(' Expr ')' ':' Statement*)* ('else' ':' Statement*)? 'endif' ';' | Statement ('elseif' '(' Expr ')' Statement)* ('else' Statement)? ;
While: Statement | ':' Statement* 'endwhile' ';' ;
For: Statement | ':' Statement* 'endfor' ';' ;
Foreach: Statement | ':' Statement* 'endforeach' ';' ;
Declare: Statement | ':' Statement* 'enddeclare' ';' ;
DeclareItem: NAME '=' Expr ;
Each: '&'? Expr | NestedList ;
Switch: '{' ';'? Case* '}' | ':' ';'? Case* 'endswitch' ';' ;
Case: 'case' Expr (':' | ';') Statement* | 'default' (':' | ';') Statement* ;
StaticVar: VAR ('=' Expr)? ;
Catch: 'catch' '(' Name ('|' Name)* VAR? ')' Block ;
Finally: 'finally' Block ;
Function!: 'function' '&'? FunctionName '(' Params ')' Returns? Block ;
FunctionName: NAME | 'readonly' ;
Class!: ClassMod* 'class' NAME ('extends' Name)? Implements? Body | 'interface' NAME ('extends' Name (',' Name)*)? Body | 'trait' NAME Body | 'enum' NAME (':' Type)? Implements? Body ;
ClassMod: 'abstract' | 'final' | 'readonly' ;
Implements: 'implements' Name (',' Name)* ;
Body: '{' Member* '}' ;
Member: Attributes MemberRest | MemberRest ;
MemberRest!: Mod+ ModMember | PlainMember | 'use' Name (',' Name)* (';' | '{' Adapt* '}') | 'case' Ident ('=' Expr)? ';' ;
Mod: 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'readonly' | 'var' | SETMOD ;
ModMember: PlainMember | Type? Property ;
PlainMember: Method | 'const' ClassConst (',' Constant)* ';' ;
ClassConst: Constant | Type Constant ;
Method!: 'function' '&'? Ident '(' Params ')' Returns? (Block | ';') ;
Property!: VAR ('=' Expr)? (',' VAR ('=' Expr)?)* ';' | VAR ('=' Expr)? Hooks ;
Hooks: '{' Hook+ '}' ;
Hook: Attributes HookRest | HookRest ;
HookRest: 'final'? '&'? NAME ('(' Params ')')? (Block | '=>' Expr ';' | ';') ;
Adapt: AdaptRef 'insteadof' Name (',' Name)* ';' | AdaptRef 'as' (AdaptMod Ident? | Ident) ';' ;
AdaptMod: 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' ;
AdaptRef: Name '::' Ident | Ident ;
Params: | Param ParamsRest ;
ParamsRest: | ',' Params ;
Param: Attributes ParamRest | ParamRest ;
ParamRest!: ParamMod* Type? '&'? '...'? VAR ('=' Expr)? Hooks? ;
ParamMod: 'public' | 'protected' | 'private' | 'readonly' | 'final' | SETMOD ;
Returns!: ':' Type ;
Type: '?' TypeAtom | TypePart TypeRest ;
TypeRest: | '|' TypePart TypeRest | '&' TypePart TypeRest ;
TypePart: TypeAtom | '(' TypeAtom ('&' TypeAtom)+ ')' ;
TypeAtom: Name | 'array' | 'callable' | 'static' ;
Name: NAME | QNAME ;
Attributes: AttributeGroup+ ;
AttributeGroup!: '#[' Attribute AttributeRest ']' ;
Attribute!: Name Args? ;
AttributeRest: | ',' | ',' Attribute AttributeRest ;
Exprs: Expr (',' Expr)* ;
Expr: Operand Rest* ;
Rest: BinOp Operand | '?' Ternary | 'instanceof' InstanceRef ;
Ternary: ':' Operand | Expr ':' Operand ;
BinOp: BINOP | '+' | '-' | '&' | '|' ;
InstanceRef: Operand ;
Prefix: PREFIX | '+' | '-' | '!' | '~' | '@' | CAST | '++' | '--' ;
Operand: Prefix Operand | 'yield' YieldRest? | YIELDFROM Operand | VarStart Post* Assign? | ArrayLit Post* Assign? | 'list' '(' Items ')' '=' '&'? Expr
 | Name NameRest? | NUMBER | Text TextRest? | '(' Expr ')' TextRest? | New | Closure | 'static' StaticRest | Attributes Closure | Attributes 'static' Closure
 | 'match' '(' Expr ')' '{' Arms '}' | 'isset' '(' Expr UnsetRest ')' | 'empty' '(' Expr ')' | 'eval' '(' Expr ')' | 'exit' Args? ;
YieldRest: Expr ('=>' Expr)? ;
NameRest: Post+ Assign? ;
TextRest: Post+ Assign? ;
StaticRest: Closure | '::' Member_ Post* Assign? | Args Post* ;
VarStart: SimpleVar ;
SimpleVar: VAR | '$' SimpleVar | '${' Expr '}' ;
Post: '[' Expr? ']' | '->' PropName | '?->' PropName | '::' Member_ | Args ;
PropName: NAME | SimpleVar | '{' Expr '}' ;
Member_: Ident | SimpleVar | '{' Expr '}' ;
Assign: '=' '&'? Expr | ASSIGN Expr | '++' | '--' ;
Args: '(' ArgList ')' ;
ArgList: | Arg ArgRest ;
ArgRest: | ',' ArgList ;
Arg: LABEL ':' Expr | '...' Expr? | Expr ;
ArrayLit: '[' Items ']' | 'array' '(' Items ')' ;
Items: Item? (',' Item?)* ;
Item: Expr ('=>' ItemValue)? | NestedList | '&' Expr | '...' Expr ;
ItemValue: '&' Expr | Expr | NestedList ;
NestedList: 'list' '(' Items ')' ;
Text: STRING | OPEN (INOPEN Expr INCLOSE)* CLOSE ;
New!: 'new' NewRef (Args Post* Assign?)? | 'new' Attributes? ClassMod* 'class' Args? ('extends' Name)? Implements? AnonymousBody Post* ;
AnonymousBody!: '{' Member* '}' ;
NewRef: Name ('::' SimpleVar NewPost*)? | 'static' ('::' SimpleVar NewPost*)? | SimpleVar NewPost* | '(' Expr ')' ;
NewPost: '[' Expr? ']' | '->' PropName | '?->' PropName | '::' SimpleVar ;
Closure!: 'function' '&'? '(' Params ')' ('use' '(' Uses ')')? Returns? Block | 'fn' '&'? '(' Params ')' Returns? '=>' Expr ;
Uses: | '&'? VAR UsesRest ;
UsesRest: | ',' Uses ;
Arms: | Arm ArmsRest ;
ArmsRest: | ',' Arms ;
Arm: ArmHead '=>' Expr ;
ArmHead: 'default' ','? | Expr ArmHeadRest ;
ArmHeadRest: | ',' | ',' Expr ArmHeadRest ;
Ident: NAME | PREFIX | BINOP | LABEL | WORDS ;
"""
#: All reserved words may name members; PREFIX and BINOP stand for some of them, so their signs have kinds of their own.
_GRAMMAR = GRAMMAR.replace("| WORDS", "".join(f"| '{w}'" for w in sorted(KEYWORDS - set(SAME))) + " | 'enum'").replace("BinOp: BINOP", "BinOp: SIGN | BINOP")
PHP = Grammar(_GRAMMAR, "Start")
K = PHP.kinds
SETMOD_RE = r"(?:public|protected|private)\(set\)"

_W = r"[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*"
_CODE = re.compile(
    rf"""
    (?P<ws>[ \t\r\n]+)
  | (?P<var>\${_W})
  | (?P<set>(?i:public|protected|private)\((?i:set)\))
  | (?P<yf>(?i:yield)[ \t\r\n]+(?i:from)\b)
  | (?P<enum>(?i:enum)(?=[ \t\r\n]+(?!(?i:extends|implements)\b){_W}))
  | (?P<name>\\?{_W}(?:\\{_W})*)
  | (?P<num>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*|(?:\d+(?:_\d+)*)?\.\d+(?:_\d+)*(?:[eE][+-]?\d+(?:_\d+)*)?|\d+(?:_\d+)*(?:\.(?:[eE][+-]?\d+)?|[eE][+-]?\d+(?:_\d+)*)?)
  | (?P<sq>'(?:[^'\\]|\\[\s\S])*')
  | (?P<dq>"(?:[^"\\$\{{]|\\[\s\S]|\$(?![A-Za-z_\{{\x80-\U0010ffff])|\{{(?!\$))*")
  | (?P<doc>/\*\*[ \t\r\n][\s\S]*?\*/)
  | (?P<comment>/\*[\s\S]*?\*/|(?:\#(?!\[)|//)(?:(?!\?>)[^\r\n])*)
  | (?P<close>\?>(?:\r\n|\n|\r)?)
  | (?P<here><<<[ \t]*(?:"(?P<h1>{_W})"|'(?P<h2>{_W})'|(?P<h3>{_W}))(?:\r\n|\n|\r))
  | (?P<cast>\([ \t]*(?i:int|integer|float|double|real|string|binary|bool|boolean|array|object|unset)[ \t]*\))
  | (?P<op>\#\[|\.\.\.|<=>|\*\*=|<<=|>>=|\?\?=|===|!==|\?->|->|=>|::|\+\+|--|\*\*|<<|>>|<=|>=|==|!=|<>|&&|\|\||\?\?|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|\$\{{|[-+*/%.=<>!?:;,&|^~@()\[\]{{}}$])
  | (?P<quote>["`])
    """,
    re.X,
)
_OPEN_TAG = re.compile(r"<\?(?:=|[pP][hH][pP](?=[ \t\r\n]|\Z)(?:\r\n|[ \t\r\n])?)")
_SIMPLE = re.compile(rf"\${_W}(?:\[(?:-?(?:0|[1-9]\d*|0[xX][0-9a-fA-F]+|0[bB][01]+|0\d+)|\${_W}|{_W})\]|(?:\?->|->){_W}|(?!\[))")
_PART = re.compile(r"[^\\$\{\"`]+")
_LABEL = re.compile(r"[ \t\r\n]*:(?!:)")
_GROUP = re.compile(rf"\\[ \t\r\n]*(?=\{{)")
_IN_NAME = re.compile(rf"{_W}(?=[\[}}])")


@dataclass
class Tokens:
    """kinds closed by END; start and stop of each in the text; docs: (the token before which it stands, text); broken: a piece that is no token was met."""

    kinds: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    docs: list[tuple[int, str]] = field(default_factory=list)
    broken: bool = False
    has_code: bool = False


_KIND_OF_WORD = {w: K[SAME.get(w, w)] for w in KEYWORDS} | {"die": K["exit"]}
_KIND_OF_OP = {o: K["SIGN"] for o in BINARY} | {o: K["ASSIGN"] for o in ASSIGN} | {o: K[o] for o in "+ - & | = ! ~ @ ++ -- -> ?-> => :: ? : ; , ( ) [ ] { } $ ${ #[ ...".split()}
ERROR = len(K)


def tokens(text: str) -> Tokens:
    """Tokens of a PHP file. What is no token becomes one of kind ERROR, and reading goes on in the next line."""
    out = Tokens()
    kinds, starts, stops = out.kinds, out.starts, out.stops
    at, size = 0, len(text)
    name_k, var_k, string_k = K["NAME"], K["VAR"], K["STRING"]
    arrow, narrow, paren, comma = K["->"], K["?->"], K["("], K[","]
    match = _CODE.match
    stack: list[tuple] = []  # of open strings: (terminator, braces open inside, its heredoc's indentation or None)
    braces = 0

    def add(kind: int, a: int, b: int) -> None:
        kinds.append(kind)
        starts.append(a)
        stops.append(b)

    def error(a: int) -> int:
        out.broken = True
        line = text.find("\n", a)
        line = size if line < 0 else line
        add(ERROR, a, line)
        return max(line, a + 1)

    def html(a: int) -> int:
        m = _OPEN_TAG.search(text, a)
        b = m.start() if m else size
        if b > a:
            add(K["HTML"], a, b)
        if not m:
            return size
        out.has_code = True
        if m[0] == "<?=":
            add(K["echo"], b, m.end())
        return m.end()

    def heredoc(m: re.Match) -> int:
        """A heredoc without code inside is one STRING; else its parts."""
        label = m["h1"] or m["h2"] or m["h3"]
        end = re.compile(rf"(?:\r\n|\n|\r)([ \t]*){label}(?![A-Za-z0-9_\x80-\U0010ffff])").search(text, m.end() - 1)
        if not end:
            return error(m.start())
        body = text[m.end() : end.start()] if end.start() >= m.end() else ""
        indent = end[1]
        if indent and any(not line.startswith(indent) and line.strip(" \t") for line in re.split(r"\r\n|\n|\r", body)):
            return error(m.start())
        if m["h2"] or "$" not in body:
            add(string_k, m.start(), end.end())
            return end.end()
        add(K["OPEN"], m.start(), m.end())
        stack.append((None, braces, (max(end.start(), m.end()), end.end())))
        return inside(m.end())

    def inside(a: int) -> int:
        """Reads on in the string on top of the stack: to its end, or to code in it."""
        nonlocal braces
        quote, outer, here = stack[-1]
        stop = here[0] if here else size
        while a < stop:
            c = text[a]
            if quote and c == quote:
                add(K["CLOSE"], a, a + 1)
                stack.pop()
                braces = outer
                return a + 1
            if c == "\\":
                a += 2
            elif c == "{" and text.startswith("{$", a):
                add(K["INOPEN"], a, a + 1)
                braces = 0
                return a + 1
            elif c == "$" and text.startswith("${", a):
                add(K["INOPEN"], a, a + 2)
                braces = 0
                if m := _IN_NAME.match(text, a + 2):
                    add(var_k, m.start(), m.end())
                    return m.end()
                return a + 2
            elif c == "$" and (m := re.compile(rf"\${_W}").match(text, a)):
                if not (s := _SIMPLE.match(text, a)):
                    stack.pop()
                    braces = outer
                    return error(a)
                a = s.end()
            elif m := _PART.match(text, a):
                a = m.end()
            else:
                a += 1
        if here:
            add(K["CLOSE"], here[0], here[1])
            stack.pop()
            braces = outer
            return here[1]
        stack.pop()
        braces = outer
        return error(size - 1 if size else 0)

    at = html(0)
    while at < size:
        m = match(text, at)
        if not m:
            at = error(at)
            continue
        group, end = m.lastgroup, m.end()
        if group == "ws" or group == "comment":
            pass
        elif group == "name":
            word = m[0]
            if "\\" in word:
                add(K["QNAME"], at, end)
            elif kinds and (kinds[-1] == arrow or kinds[-1] == narrow):
                add(name_k, at, end)
            else:
                low = word.lower()
                kind = _KIND_OF_WORD.get(low)
                if kinds and (kinds[-1] == paren or kinds[-1] == comma) and _LABEL.match(text, end):
                    kind = K["LABEL"]
                elif low == "__halt_compiler":
                    add(K["__halt_compiler"], at, end)
                    rest = re.compile(r"[ \t\r\n]*\([ \t\r\n]*\)[ \t\r\n]*(?:;|\?>)").match(text, end)
                    if not rest:
                        at = end
                        continue
                    for k in "();":
                        add(K[k], rest.start(), rest.end())
                    break
                add(name_k if kind is None else kind, at, end)
            if g := _GROUP.match(text, end):
                add(K["GROUP"], g.start(), g.end())
                end = g.end()
        elif group == "var":
            add(var_k, at, end)
        elif group == "op":
            op = m[0]
            if op in ("{", "${"):
                braces += 1
            elif op == "}":
                if stack and braces == 0:
                    add(K["INCLOSE"], at, end)
                    at = inside(end)
                    continue
                braces -= 1
                if kinds and kinds[-1] == comma and K["GROUP"] in kinds[-400:]:
                    kinds[-1] = _trailing(kinds)
            add(_KIND_OF_OP[op], at, end)
        elif group == "sq" or group == "dq":
            add(string_k, at, end)
        elif group == "num":
            add(K["NUMBER"], at, end)
        elif group == "doc":
            out.docs.append((len(kinds), m[0]))
        elif group == "close":
            add(K[";"], at, end)
            at = html(end)
            continue
        elif group == "h1" or group == "h2" or group == "h3" or group == "here":
            at = heredoc(m)
            continue
        elif group == "cast":
            add(K["CAST"], at, end)
        elif group == "set":
            add(K["SETMOD"], at, end)
        elif group == "yf":
            add(K["YIELDFROM"], at, end)
        elif group == "enum":
            if kinds and kinds[-1] in (arrow, narrow, K["::"]):
                add(name_k, at, end)
            else:
                add(K["enum"], at, end)
        elif group == "quote":
            add(K["OPEN"], at, end)
            stack.append((m[0], braces, None))
            at = inside(end)
            continue
        at = end
    add(K[END], size, size)
    return out


def _trailing(kinds: list[int]) -> int:
    """The kind of a comma before `}`: its own in a group of use."""
    depth = 0
    for k in range(len(kinds) - 2, -1, -1):
        if kinds[k] == K["{"]:
            return K["TRAILCOMMA"] if k and kinds[k - 1] == K["GROUP"] else K[","]
        if kinds[k] == K["}"]:
            break
    return K[","]
