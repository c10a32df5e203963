"""Grammars as productions over the tokens of one nesting level, and what is derived from them.

Brackets are groups: inside their parent a whole group is one symbol, P for ( ), K for [ ], B for { } and Z for an
indented block. A production is written in words and | ( ) ? * +; <name> stands for another production. From the
productions follow, by rule, a regular expression over one character per class, and the set of pairs of classes that
may stand next to each other.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex

from cartolith.llm.lexing import KEYWORDS

_SYMBOLS: dict[str, str] = {}


def symbol(word: str) -> str:
    """The one character for a token class."""
    if word not in _SYMBOLS:
        raise KeyError(word)
    return _SYMBOLS[word]


_OWN = (
    "I N S T E P K B Z G ERR ! NL INDENT DEDENT ( ) [ ] { } ; , . ?. :: -> => ... ? : = b u x + - * < > & && | ~ @ op= := ** => ^ $".split()
    + sorted({w for words in KEYWORDS.values() for w in words})
)
for _n, _w in enumerate(dict.fromkeys(_OWN)):
    _SYMBOLS[_w] = chr(0x100 + _n)
#: What a bracket group is in its parent.
GROUPS = {"(": "P", "[": "K", "{": "B", "INDENT": "Z"}

_JS_NAME = "( I | of | from | as | async | static | get | set | let )"
_TS_NAME = "( I | of | from | as | async | static | get | set | let | type | namespace | module | declare | abstract | readonly | override | is | infer | satisfies | enum | keyof )"


def _script(ts: bool) -> dict[str, str]:
    """JavaScript, and TypeScript with its types."""
    name, ann = (_TS_NAME, "( : <type> )?") if ts else (_JS_NAME, "")
    ret = "( : ( I? <name> is )? <type> )?" if ts else ""
    g = "G?" if ts else ""
    mods = "( async | static | get | set | * " + ("| public | private | protected | readonly | abstract | declare | override " if ts else "") + "| @ <name> ( . <name> )* P? )*"
    d = {
        "name": name,
        "type": "( ( b | & | '|' )? ( ( keyof | readonly | typeof | infer | new | abstract )* ( ( <name> | void | this | import P | S | N | - N | T | P | K | B | new P ) ( . <name> )* G? ( K )* ( is <type1> )? ) ) ( extends <type1> ? <type1> : <type1> )? ( => ( <name> is )? <type1> )? ( ( '|' | & ) <type1> ( => <type1> )? )* )",
        "type1": "( ( keyof | readonly | typeof | infer )* ( <name> | void | this | S | N | - N | T | P | K | B ) ( . <name> )* G? ( K )* ( => ( <name> | void | S | P | B ) G? K* )? )",
        "unary": "( u | ! | + | - | x | typeof | void | delete | await | yield *? | new | async " + ("| G (?= P ) | < <name> > " if ts else "") + "| ... )",
        "operand": "( " + ("P : ( I? <name> is )? <type> (?= => ) | " if ts else "") + "async? function *? <name>? " + g + " P " + ret + " B | ( @ <name> P? )* class <name>? " + g + " ( extends <name> ( . <name> | P )* " + g + " )? " + ("( implements <type> ( , <type> )* )? " if ts else "") + "B | import P | import . <name> | <name> | N | S | T | P | K | B | this | super " + ("" if ts else "| E ") + ")",
        "post": "( . ( <name> | this ) | ?. ( <name> | P | K ) | P | K | T | x " + ("| ! | G (?= P | T ) | ( as | satisfies ) ( const | I (?! . ) | <type> ) " if ts else "") + ")",
        "binary": "( = | b | + | - | * | < | > >? >? | & | '|' | && | => | in | instanceof " + ") ( async (?= function | P | I ) )?",
        "term": "<unary>* <operand> <post>*",
        "flat": "<term> ( <binary> <term> )*",
        "expr": "{{ ( yield (?= ; | $ | , ) | <flat> ( ? <flat> ( ? <flat> : <flat> )? : <flat> )* ) }}",
        "list": "<expr> ( , <expr> )*",
        "target": "( <name> | K | B " + ("" if ts else "| E ") + ") " + ("!? " if ts else "") + ann,
        "binding": "<target> ( = <expr> )?",
        "bindings": "<binding> ( , <binding> )*",
        "end": "( ; | $ )",
        "prop": "( " + mods + " ( <name> | S | N | K | this | super ) ( P " + ret + " B | " + g + " P " + ret + " B ) | ( <name> | S | N | K ) : <expr> | <name> ( = <expr> )? | ... <expr> )",
        "object": "( <prop> ( , <prop> )* ,? )?",
        "names": "( ( " + ("type? " if ts else "") + "( <name> | S | default ) ( as ( <name> | S | default ) )? ) ( , " + ("type? " if ts else "") + "( <name> | S | default ) ( as ( <name> | S | default ) )? )* ,? )?",
        "class": "( " + mods + " ( <name> | S | N | K ) ( ? | ! )? " + g + " P " + ret + " ( B | ; " + ") | " + mods + " ( <name> | S | N | K ) ( ? | ! )? " + ann + " ( = <expr> )? ( ; | $ ) | static B | ; " + ("| " + mods + " K : <type> ; " if ts else "") + ")*",
        "cases": "( ( case <list> | default ) : ( <statement> )* )*",
        "decl": ("( declare | abstract )* " if ts else "") + "( ( const | let | var ) <bindings> <end> | async? function *? <name> " + g + " P " + ret + " ( B " + ("| ; " if ts else "") + ") | ( @ <name> ( . <name> )* P? )* " + ("abstract? " if ts else "") + "class <name> " + g + " ( extends <name> ( . <name> | P )* " + g + " )? " + ("( implements <type> ( , <type> )* )? " if ts else "") + "B "
        + ("| interface <name> G? ( extends <type> ( , <type> )* )? B | type <name> G? = <type> <end> | const? enum <name> B | ( namespace | module ) ( <name> ( . <name> )* | S ) B " if ts else "") + ")",
        "statement": "( if P | for await? P | while P | else | do | <name> : | with P )* ( ; | <decl> | " + ("import type? <name> = <expr> <end> | export = <expr> <end> | declare I B | " if ts else "") + "import ( S | " + ("type? " if ts else "") + "( <name> ( , ( B | * as <name> ) )? | B | * as <name> ) from S ( with B )? ) <end> | import P <post>* <end> | ( @ <name> ( . <name> )* P? )* export ( default ( <decl> | async? function *? P B | class ( extends <name> )? B | <expr> <end> ) | <decl> | " + ("type? " if ts else "") + "B ( from S )? <end> | * ( as <name> )? from S <end> ) | return <list>? <end> | throw <list> <end> | ( break | continue ) I? <end> | debugger <end> | while P <end> | try B ( catch P? B )? ( finally B )? | switch P B | B (?! . | = | [ ) ;? | <list> <end> )",
        "block": "<statement>*",
        "params": "( ( @ <name> P? )* " + ("( public | private | protected | readonly | override )* " if ts else "") + "( ...? ( <name> | K | B | this ) " + ("?? " if ts else "") + ann + " ( = <expr> )? ) ( , ( @ <name> P? )* " + ("( public | private | protected | readonly | override )* " if ts else "") + "...? ( <name> | K | B ) " + ("?? " if ts else "") + ann + " ( = <expr> )? )* ,? )?",
        "head": "( ( const | let | var ) <bindings>? | <list> )? ; <list>? ; <list>? | ( ( const | let | var ) <target> | <name> ) ( of | in ) <list>",
        "arguments": "( <expr> ( , <expr> )* ,? )?",
        "elements": "( ,* <expr> ( ,+ <expr> )* ,* | ,* )?",
    }
    if ts:
        d["interface"] = "( readonly? ( get | set )? ( <name> | S | N | K | new )? ?? ( : <type> | G? P ( : ( <name> is )? <type> )? | (?= ; | , ) ) ( ; | , | $ ) | K ( : <type> ) ( ; | , | $ ) | + | - )*"
        d["enum"] = "( ( <name> | S ) ( = <expr> )? ( , ( <name> | S ) ( = <expr> )? )* ,? )?"
        d["types"] = "( <type> ( , <type> )* ,? | readonly? <name> : <type> | <name> in <type> )?"
    d |= {"(": "arguments params head" + (" types" if ts else ""), "[": "elements" + (" types" if ts else ""), "{": "block object class cases names" + (" interface enum" if ts else ""), "top": "block"}
    return d


_JAVA = {
    "note": "@ I ( . I )* P?",
    "mods": "( <note> | static | public | private | protected | final | abstract | synchronized | native | transient | volatile | strictfp | default )*",
    "type": "( <note> )* ( void | I ( . I | G )* ) ( K )* ...?",
    "unary": "( u | + | - | x | P (?= I | N | S | P | u | this | super | new ) )",
    "operand": "( new ( <note> )* ( I | void ) ( . I | G )* ( P B? | K+ B? ) | switch P B | I | N | S | P | this | super | void K* (?= . class | :: ) | K+ (?= :: ) )",
    "post": "( . ( G? I | class | new I G? P B? | this | super ) | P | K | x | :: ( I | new ) | G (?= :: ) )",
    "term": "( ( P | I ) -> )* ( B | <unary>* <operand> <post>* ( instanceof final? <type> I? P? )? )",
    "flat": "<term> ( ( = | b | + | - | * | < | > >? >? | & | && | '|' ) <term> )*",
    "expr": "{{ <flat> ( ? <flat> ( ? <flat> : <flat> )? : <flat> )* }}",
    "list": "<expr> ( , <expr> )*",
    "init": "( <expr> | B )",
    "vars": "<type> I K* ( = <init> )? ( , I K* ( = <init> )? )*",
    "generic": "G?",
    "kind": "<mods> ( class I G? ( extends <type> )? ( implements <type> ( , <type> )* )? B | interface I G? ( extends <type> ( , <type> )* )? B | @ interface I B | enum I ( implements <type> ( , <type> )* )? B | I I G? P ( implements <type> ( , <type> )* )? B )",
    "member": "( ; | static? B | <kind> | <mods> G? <type>? I P K* ( throws <type> ( , <type> )* )? ( B | default <expr> ; | ; ) | <mods> <vars> ; )",
    "class": "( I P? B? ( , I P? B? )* ,? ;? )? <member>*",
    "statement": "( if P | for P | while P | else | do | I : )* ( ; | <kind> | <mods> <vars> ; | B | try P? B ( catch P B )* ( finally B )? | switch P B | synchronized P B | return <expr>? ; | throw <expr> ; | yield <expr> ; | assert <expr> ( : <expr> )? ; | ( break | continue ) I? ; | <expr> ; )",
    "block": "<statement>*",
    "cases": "( ( case ( <flat> ( , <flat> )* | <type> I ) | default ) ( : <statement>* | -> ( B | <expr> ; | throw <expr> ; ) ) )*",
    "array": "( ( <expr> | B ) ( , ( <expr> | B ) )* ,? )?",
    "unit": "( <note>* package I ( . I )* ; )? ( import static? I ( . I )* ( . * )? ; )* ( <kind> | ; )*",
    "params": "( ( <note> | final )* <type> ( I K* | this ) ( , ( <note> | final )* <type> I K* )* )?",
    "head": "( <mods> <vars> | <list> )? ; <expr>? ; <list>? | <mods> <type> I : <expr>",
    "args": "( <expr> ( , <expr> )* )?",
    "cast": "<type> ( & <type> )*",
    "resources": "( <mods> <vars> | <expr> ) ( ; ( <mods> <vars> | <expr> ) )* ;?",
    "catch": "( final )* <type> ( '|' <type> )* I",
    "names": "I ( , I )*",
    "annotation": "( I = ( <expr> | B ) ( , I = ( <expr> | B ) )* | B )",
    "index": "<expr>?",
    "(": "args params head cast resources catch names annotation", "[": "index", "{": "block class cases array", "top": "unit",
}

_CPP = {
    "attr": "( K | alignas P )*",
    "spec": "( static | const | constexpr | inline | extern | mutable | volatile | explicit P? | friend | virtual | thread_local | typedef | consteval | constinit )",
    "name": "( :: )? ( I | operator ) G? ( :: ( template? ( I | ~ I | operator ) G? ) )*",
    "path": "( :: )? I G? ( :: template? I G? )*",
    "core": "( ( typename | class | struct | enum | union )? <path> | auto | void | decltype P )",
    "type": "( const | volatile | constexpr | static | inline )* <core> ( const | volatile )* ( * | & | && | const | volatile | ... )*",
    "unary": "( u | ~ | + | - | * | & | && | x | sizeof ...? | co_await | throw | new P? | delete K? | P (?= I | N | S | P | u | :: | this | new ) )",
    "lambda": "K ( G? P )? ( mutable | constexpr | noexcept P? )* ( -> <type> )? B",
    "operand": "( <lambda> | new P? <type> ( P | K+ | B )? | void ( P | B ) | <path> B? | N I? | S+ I? | P | B | this | I | sizeof P | decltype P | typename <path> | auto P | requires P? B | ( const )? <path> ( * | & )* (?= $ ) | operator b | noexcept P | ... )",
    "post": "( ( . | -> ) ( template? <name> | * <path> | ~ I ) | P | K | x | B | ... | I (?= P ) (?! I ) )",
    "term": "<unary>* <operand> <post>*",
    "flat": "<term> ( ( = | b | + | - | * | < | > >? | & | && | '|' ) ( B | <term> ) )*",
    "expr": "{{ <flat> ( ? <flat> ( ? <flat> : <flat> )? : <flat> )* }}",
    "list": "<expr> ( , <expr> )*",
    "opname": "operator ( b | u | x | + | - | * | & | && | '|' | ~ | = | < | > | , | P | K | new K? | delete K? | -> | <type> )",
    "declname": "( ( <path> :: )? <opname> | <path> ( :: ~ I )? | P (?= P ) | ~ I )",
    "quals": "( const | volatile | noexcept P? | override | final | & | && | throw P | <attr1> | mutable | requires <expr> )*",
    "attr1": "K",
    "declarator": "( * | & | && | const | ... )* ( <declname> K* ( : <expr> )? | P (?= P ) | K )",
    "init": "( = ( <expr> | B | default | delete | N ) | B | P )",
    "vars": "<declarator> <init>? ( , <declarator> <init>? )*",
    "function": "<spec>* ( <type> )? ( * | & | && )* <declname> P <quals> ( -> <type> )? ( try )? ( : <path> ( P | B ) ( ... )? ( , <path> ( P | B ) ( ... )? )* )?",
    "bases": "( : ( public | private | protected | virtual )* <path> ...? ( , ( public | private | protected | virtual )* <path> ...? )* )?",
    "record": "<spec>* ( class | struct | union | enum ( class | struct )? ) <attr> <path>? final? ( : <type> (?= B ) | <bases> )",
    "template": "( template < > | template G | requires ( P | <path> ) )*",
    "declaration": "<template> ( <attr> <record> B ( <vars> )? ; | <record> ; | <attr> <spec>* using <path> = <type> ( P )? ; | using namespace? <path> ; | using enum? <path> ; | concept I = <expr> ; | static_assert P ; | inline? namespace <attr> ( I ( :: inline? I )* )? B | namespace I = <path> ; | extern S ( B | <declaration1> ) | friend ( class | struct )? <type> ; "
    "| <attr> <function> B | <attr> <function> ( = ( default | delete | N ) )? ; | <attr> <spec>* <type> <vars>? ; | template <core> ; )",
    "declaration1": "<spec>* <type> <vars> ;",
    "statement": "( if constexpr? P | for P | while P | else | do | I : | case <flat> : | default : | ( public | private | protected ) I? : | K )* ( ; | B ;? | try B ( catch P B )+ | switch P B | return ( <list> | B )? ; | throw <expr>? ; | ( break | continue ) ; | goto I ; | co_return <expr>? ; | ( co_yield | delete ) <expr> ; | <declaration> | <list> ; | I P (?= I | $ | static | void | const | auto ) | I (?= public | private | protected ) )",
    "block": "<statement>* ( ( case <flat> | default | public | private | protected | I ) : )*",
    "enumerators": "( I ( = <expr> )? ( , I ( = <expr> )? )* ,? )?",
    "values": "( ( ( . I = )? ( <expr> | B ) ) ( , ( ( . I = )? ( <expr> | B ) ) )* ,? )?",
    "param": "( <attr> <spec>* <type> ( <declarator> | ... | P P )? ( = ( <expr> | B ) )? | ... )",
    "params": "( <param> ( , <param> )* )?",
    "args": "( ( <expr> | B | <type> ) ( , ( <expr> | B | <type> ) )* )?",
    "head": "( <spec>* <type> <vars> | <list> )? ; ( <list> )? ; <list>? | ( <spec>* <type> <vars> ; )? <attr> <spec>* <type> ( * | & | && )* ( I | K ) : ( <expr> | B ) | ( <spec>* <type> <vars> | <list> ) ; ( <list> | <spec>* <type> <vars> ) | <spec>* <type> <vars>",
    "declares": "( * | & | && )* ( <path> ::? *? )? ( I )? K*",
    "oper": "( b | & | * )*",
    "subscript": "( <list> | B )?",
    "captures": "( ( & | = | * this | this | &? ...? I ( = <expr> | P | B )? ...? ) ( , ( & | = | this | * this | &? ...? I ( = <expr> | P )? ...? ) )* )?",
    "attribute": "K",
    "names": "( I ( :: I )* P? ( , I ( :: I )* P? )* )?",
    "(": "args params head declares oper", "[": "subscript captures attribute names", "{": "block enumerators values", "top": "block",
}

_PY = {
    "name": "( I )",
    "unary": "( not | ~ | + | - | await | * | ** )",
    "operand": "( I | N | S+ | P | K | E | B | ... )",
    "post": "( . I | P | K )",
    "lambda": "lambda ( ( * | ** )* ( I ( = <plain> )? )? ( , ( * | ** | b )* ( I ( = <plain> )? )? )* )? :",
    "plain": "( not | ~ | + | - | await )* <operand> <post>* ( ( b | + | - | * | ** | @ | in | not in | is not? | and | or | '|' | & ) ( not | ~ | + | - | await )* <operand> <post>* )*",
    "term": "( <lambda> )* <unary>* <operand> <post>*",
    "binary": "( b | + | - | * | ** | @ | in | not in | is not? | and | or | '|' | & | < | > )",
    "flat": "<term> ( <binary> <term> )*",
    "expr": "{{ <flat> ( if <flat> else ( <lambda> )* <flat> )* }}",
    "named": "<expr> ( := <expr> )?",
    "list": "<named> ( , <named> )* ,?",
    "star": "( yield ( from <expr> | <list> )? | <list> )",
    "small": "( <star> ( = <star> )* | <expr> op= <star> | <expr> : <expr> ( = <star> )? | pass | break | continue | return <list>? | raise ( <expr> ( from <expr> )? )? | del <list> | assert <expr> ( , <expr> )? | ( global | nonlocal ) I ( , I )* | import I ( . I )* ( as I )? ( , I ( . I )* ( as I )? )* | from ( . | ... )* ( I ( . I )* )? import ( P | * | I ( as I )? ( , I ( as I )? )* ) | I I K? = <expr> )",
    "simple": "<small> ( ; <small> )* ;? NL",
    "suite": ": ( NL Z | <simple> )",
    "targets": "( <unary>* <operand> <post>* ) ( , <unary>* <operand> <post>* )* ,?",
    "compound": "( if <named> <suite> ( elif <named> <suite> )* ( else <suite> )? | async? for <targets> in <list> <suite> ( else <suite> )? | while <named> <suite> ( else <suite> )? | try <suite> ( ( except *? ( <list> ( as I )? )? <suite> )+ ( else <suite> )? ( finally <suite> )? | finally <suite> ) | async? with ( <expr> ( as <operand> <post>* )? ) ( , <expr> ( as <operand> <post>* )? )* <suite> | async? def I K? P ( -> <expr> )? <suite> | class I K? P? <suite> | ( I | case ) <list> : NL Z | ( I ) <expr> ( as I )? ( if <expr> )? : ( NL Z | <simple> ) )",
    "decorated": "( @ <named> NL )*",
    "block": "( NL | <decorated> ( <compound> | <simple> ) )*",
    "comp": "( async? for <targets> in <flat> ( if <flat> )* )*",
    "args": "( ( ( I = )? ( <named> ) <comp> ) ( , ( ( I = )? <named> <comp> ) )* ,? | yield ( from <expr> | <list> )? )?",
    "params": "( ( * | ** | b )* ( I ( : <expr> )? )? ( = <expr> )? ( , ( * | ** | b )* ( I ( : <expr> )? )? ( = <expr> )? )* ,? )?",
    "imports": "I ( as I )? ( , I ( as I )? )* ,?",
    "withs": "<expr> ( as <operand> <post>* )? ( , <expr> ( as <operand> <post>* )? )* ,?",
    "slice": "( ( <named>? ( : <expr>? ( : <expr>? )? )? <comp> ) ( , ( <named>? ( : <expr>? ( : <expr>? )? )? ) )* )?",
    "pairs": "( ( <expr> : <expr> <comp> | ** <expr> ) ( , ( <expr> : <expr> | ** <expr> ) )* ,? | ( <named> <comp> ) ( , <named> )* ,? )?",
    "(": "args params imports withs", "[": "slice", "{": "pairs", "INDENT": "block", "top": "block",
}

_JSON = {
    "value": "( S | N | I | B | K )",
    "members": "( S : <value> ( , S : <value> )* )?",
    "items": "( <value> ( , <value> )* )?",
    "document": "<value>",
    "[": "items", "{": "members", "top": "document",
}

GRAMMARS: dict[str, dict[str, str]] = {"javascript": _script(False), "typescript": _script(True), "java": _JAVA, "cpp": _CPP, "python": _PY, "json": _JSON}
CLOSERS = {"(": ")", "[": "]", "{": "}", "INDENT": "DEDENT"}


_CALL = re.compile(r"<([a-z0-9]+)>([?*+]?)")


def _pattern(text: str) -> str:
    out = []
    for w in text.split():
        if m := _CALL.fullmatch(w):
            out.append(f"(?&{m[1]}){m[2]}")
        elif w in ("(", "|"):
            out.append("(?:" if w == "(" else "|")
        elif re.fullmatch(r"\)[?*+]?", w) or w in ("(?=", "(?!"):
            out.append(w)
        elif w in ("{{", "}}"):
            out.append("(?>" if w == "{{" else ")")
        elif w == "$":
            out.append(r"\Z")
        elif w.startswith("'"):
            out.append(symbol(w.strip("'")))
        elif w in _SYMBOLS:
            out.append(symbol(w))
        elif w[:-1] in _SYMBOLS and w[-1] in "?*+":
            out.append(symbol(w[:-1]) + w[-1])
        else:
            raise ValueError(w)
    return "".join(out)


@lru_cache(None)
def _compiled(lang: str, name: str) -> regex.Pattern[str]:
    used, todo = {}, [name]
    while todo:
        n = todo.pop()
        if n not in used:
            used[n] = GRAMMARS[lang][n]
            todo += [m[1] for m in _CALL.finditer(used[n])]
    return regex.compile("(?(DEFINE)" + "".join(f"(?P<{n}>{_pattern(text)})" for n, text in used.items()) + f")(?&{name})")


@lru_cache(None)
def pairs(lang: str) -> frozenset[str]:
    """Pairs of symbols that may be neighbours in a group of the language, its brackets included, by the productions:
    if x y is part of a production, what x can end with may stand before what y can begin with."""
    found: set[tuple[str, str]] = set()
    known: dict[str, tuple[set[str], set[str], bool]] = {}

    def production(name: str) -> tuple[set[str], set[str], bool]:
        if name not in known:
            known[name] = alternatives(GRAMMARS[lang][name].split(), 0)[:3]
        return known[name]

    def alternatives(words: list[str], i: int) -> tuple[set[str], set[str], bool, int]:
        """(what it can begin with, end with, whether it may be empty, next word) up to the closing parenthesis."""
        first, last, empty = set(), set(), False
        cur_first, cur_last, cur_empty = set(), set(), True
        while True:
            w = words[i] if i < len(words) else None
            if w is None or w in ("|", "}}") or w.startswith(")"):
                first |= cur_first
                last |= cur_last
                empty |= cur_empty
                if w != "|":
                    return first, last, empty, i
                cur_first, cur_last, cur_empty = set(), set(), True
                i += 1
                continue
            if w in ("(?=", "(?!"):  # looks ahead and takes nothing
                level = 1
                while level:
                    i += 1
                    level += words[i] in ("(", "(?=", "(?!")
                    level -= words[i].startswith(")")
                i += 1
                continue
            if w == "$":
                i += 1
                continue
            if w in ("(", "{{"):
                f, la, em, i = alternatives(words, i + 1)
                mark = words[i][1:] if words[i].startswith(")") else ""
            elif m := _CALL.fullmatch(w):
                f, la, em = production(m[1])
                mark = m[2]
            else:
                mark = w[-1] if w not in _SYMBOLS and not w.startswith("'") else ""
                s = symbol(w.strip("'") if w.startswith("'") else w[:-1] if mark else w)
                f, la, em = {s}, {s}, False
            i += 1
            if mark in ("*", "+"):
                found.update((a, b) for a in la for b in f)
            em = em or mark in ("*", "?")
            found.update((a, b) for a in cur_last for b in f)
            if cur_empty:
                cur_first = cur_first | f
            cur_last = cur_last | la if em else set(la)
            cur_empty = cur_empty and em

    for group in GRAMMARS[lang]:
        if group not in (*CLOSERS, "top"):
            continue
        for name in GRAMMARS[lang][group].split():
            f, la, _ = production(name)
            if group != "top":
                o, c = symbol(group), symbol(CLOSERS[group])
                found.update((o, b) for b in f)
                found.update((a, c) for a in la)
                found.add((o, c))
    if lang in ("cpp", "typescript", "java"):  # type arguments are < ... > until they are reduced to G
        every = {s for p in found for s in p}
        angle = [symbol("<"), symbol(">")]
        found.update((a, b) for a in every for b in every if a in angle or b in angle)
        found.update((symbol(","), symbol(t)) for t in ("I", "const", "typename", "class", "?", "void", "...") if symbol(t) in every)
        found.update((symbol(a), symbol(b)) for a in ("*", "&", "&&", "K", "const", "...") for b in (",", ">") if {symbol(a), symbol(b)} <= every)
        found.update((symbol(a), symbol(b)) for a, b in (("?", "extends"), ("?", "super"), ("I", "extends"), ("extends", "I"), ("super", "I"), ("typename", "..."), ("class", "..."), ("typename", "I"), ("...", "I"), ("I", "=")) if {symbol(a), symbol(b)} <= every)
    return frozenset(a + b for a, b in found)


def _angle(lang: str) -> re.Pattern[str]:
    words = {"java": "I . , ? & K @ extends super G void", "typescript": "I . , ? & | K B P S N T G extends keyof typeof void = => - this readonly infer is in of from as get set static type async", "cpp": "I N S :: , * & && K P G const volatile typename class struct ... = auto b - + void unsigned enum template u | decltype sizeof"}[lang]
    inner = "".join(re.escape(symbol(w)) for w in words.split() if w in _SYMBOLS)
    before = "".join(re.escape(symbol(w)) for w in ("I template operator async static get set new . ; { ( , = class public private protected static final abstract synchronized default : extends K return").split() if w in _SYMBOLS)
    return re.compile(f"(?<=[{before}]){symbol('<')}[{inner}]*{symbol('>')}")


_ANGLE = {lang: _angle(lang) for lang in ("java", "typescript", "cpp")}


@lru_cache(50_000)
def valid_group(lang: str, symbols: str) -> bool:
    """Whether a group, from its opening to its closing bracket ('^' and '$' at the top level), is well-formed."""
    if lang in _ANGLE and symbol("<") in symbols and symbol(">") in symbols:
        forms = [_reduced(lang, symbols), symbols]
    else:
        forms = [symbols]
    return any(_matches(lang, s) for s in dict.fromkeys(forms))


def _reduced(lang: str, symbols: str) -> str:
    while True:
        s = _ANGLE[lang].sub(symbol("G"), symbols)
        if s == symbols:
            return s
        symbols = s


def _matches(lang: str, symbols: str) -> bool:
    head, body, tail = symbols[0], symbols[1:-1], symbols[-1]
    group = next((g for g in (*CLOSERS, "top") if (head == "^" if g == "top" else head == symbol(g))), None)
    if group is None or tail != ("$" if group == "top" else symbol(CLOSERS[group])) or group not in GRAMMARS[lang]:
        return False
    for name in GRAMMARS[lang][group].split():
        if name == "block":
            at, one = 0, _compiled(lang, "statement" if "statement" in GRAMMARS[lang] else "block")
            while at < len(body):
                m = one.match(body, at)
                if not m or m.end() == at:
                    break
                at = m.end()
            if at == len(body) or _compiled(lang, "block").fullmatch(body):
                return True
        elif _compiled(lang, name).fullmatch(body):
            return True
    return False


def check(tokens: list[tuple[str, int]], lang: str) -> tuple[bool, list[str]]:
    """Reference form for one token list, as the DataFrame form computes it: (valid, groups)."""
    stack, groups = [["^"]], []
    for kind, step in tokens:
        if step > 0:
            stack[-1].append(symbol(GROUPS[kind]))
            stack.append([symbol(kind)])
        elif step < 0:
            stack[-1].append(symbol(kind))
            groups.append("".join(stack.pop()))
            if not stack:
                return False, groups
        else:
            stack[-1].append(symbol(kind))
    if len(stack) != 1:
        return False, groups
    groups.append("".join(stack.pop()) + "$")
    ok = pairs(lang)
    good = all(valid_group(lang, g) and all(g[i : i + 2] in ok for i in range(len(g) - 1) if g[i] != "^" and g[i + 1] != "$") for g in groups)
    return good, groups
