"""Grammars of the source languages for the chart parser; flat where precedence does not matter for validity."""

from __future__ import annotations

from functools import cache

from .engine import Grammar
from .lexers import GO_KEYWORDS, JS_CONTEXT, JS_RESERVED, PY_KEYWORDS, RUST_KEYWORDS


def _any(words) -> str:
    return " | ".join(f"'{w}'" for w in sorted(words))


def _rules(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in text.strip().splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        name, sep, body = line.partition(" = ")
        if sep and name.isidentifier():
            out[name] = body
        else:  # continuation
            last = next(reversed(out))
            out[last] += " " + line
    return out


# ---------------------------------------------------------------------------------------------------------------------
_JS = """
file = stmt* EOF
stmt = block | ';' | decl | flow | importdecl | exportdecl | ID ':' stmt | exprstmt
block = '{' stmt* '}'
decl = vardecl SEMI | funcdecl | classdecl TSDECL
exprstmt = sassign (',' assign)* SEMI
vardecl = ('var' | 'let') vard (',' vard)* | 'const' cvard (',' cvard)*
vard = ID TSBANG VTYPE ('=' assign)? | (objpat | arrpat) VTYPE '=' assign
cvard = binding VTYPE '=' assign
flow = 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'? | forstmt
  | 'continue' ID? SEMI | 'break' ID? SEMI | 'return' expr? SEMI | 'throw' expr SEMI | 'debugger' SEMI | switch | trystmt
forstmt = 'for' 'await'? '(' forhead ')' stmt
forhead = (vardecl | expr)? ';' expr? ';' expr? | ('var' | 'let' | 'const') binding VTYPE ('of' | 'in') expr | operand ('of' | 'in') expr
switch = 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* '}'
trystmt = 'try' block ('catch' ('(' binding VTYPE ')')? block ('finally' block)? | 'finally' block)
funcdecl = 'async'? 'function' '*'? ID TYPARAMS params RET FBODY
funcexpr = 'async'? 'function' '*'? ID? TYPARAMS params RET block
params = '(' (param (',' param)* ','?)? ')'
param = PMOD '...'? PNAME VTYPE ('=' assign)?
binding = ID | objpat | arrpat
objpat = '{' (bprop (',' bprop)* ','?)? '}'
bprop = '...' binding | propname ':' binding ('=' assign)? | ID ('=' assign)?
arrpat = '[' ','* (belem (','+ belem)* ','*)? ']'
belem = '...'? binding ('=' assign)?
classdecl = decorator* ABSTRACT 'class' ID classrest
classexpr = decorator* ABSTRACT 'class' ID? classrest
classrest = TYPARAMS ('extends' operand)? IMPLEMENTS '{' member* '}'
decorator = '@' operand
member = ';' | 'static' block | decorator* MMOD* (method | fieldm TSINDEX)
method = '*'? propname TSOPT TYPARAMS params RET FBODY
fieldm = propname TSOPTBANG VTYPE ('=' assign)? SEMI
importdecl = 'import' (STR | TSTYPE importclause 'from' STR) withclause? SEMI TSIMPORT
withclause = 'with' object
importclause = ID (',' (nsimport | namedimport))? | nsimport | namedimport
nsimport = '*' 'as' ID
namedimport = '{' (ispec (',' ispec)* ','?)? '}'
ispec = TSTYPE (IDN | STR) ('as' (IDN | STR))?
exportdecl = 'export' (vardecl SEMI | funcdecl | classdecl | exportdef | '*' ('as' (IDN | STR))? 'from' STR withclause? SEMI
  | TSTYPE namedimport ('from' STR withclause?)? SEMI TSEXPORT)
exportdef = 'default' (funcexpr | classexpr | sassign SEMI | object SEMI TSDEFAULT)
expr = assign (',' assign)*
assign = operand TAIL
sassign = soperand TAIL
nassign = noperand TAIL
binop = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof'
asgop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
operand = PREFIX* (primary POSTFIX* | arrow) | 'yield'
soperand = PREFIX+ (primary POSTFIX* | arrow) | sprimary POSTFIX* | arrow | 'yield'
noperand = PREFIX+ (primary POSTFIX* | arrow) | nprimary POSTFIX* | arrow | 'yield'
sprimary = PRIM
nprimary = PRIM | funcexpr | classexpr
primary = PRIM | funcexpr | classexpr | object
arrow = 'async'? (ID | TYPARAMS params RET) '=>' (block | nassign)
object = '{' (prop (',' prop)* ','?)? '}'
prop = '...' assign | propname ':' assign | ID ('=' assign)? | ('get' | 'set' | 'async')? '*'? propname TYPARAMS params RET block
propname = IDN | STR | NUM | '[' assign ']' | PRIVATE
array = '[' ','* (elem (','+ elem)* ','*)? ']'
elem = '...'? assign
args = '(' (elem (',' elem)* ','?)? ')'
template = TPL | TPL_HEAD expr (TPL_MID expr)* TPL_TAIL
"""

_TS = """
interface = 'interface' ID TYPARAMS ('extends' typeref (',' typeref)*)? objtype
typealias = 'type' ID TYPARAMS '=' type SEMI
enum = 'const'? 'enum' ID '{' (enumm (',' enumm)* ','?)? '}'
enumm = propname ('=' assign)?
namespace = ('namespace' | 'module') (ID ('.' IDN)* | STR) block | 'global' block
declare = 'declare' (ambient SEMI | funcdecl | classdecl | interface | typealias | enum | dnamespace | 'module' STR SEMI)
dnamespace = ('namespace' | 'module') (ID ('.' IDN)* | STR) ablock | 'global' ablock
ablock = '{' (stmt | 'export'? ambient SEMI)* '}'
ambient = ('var' | 'let' | 'const') binding VTYPE (',' binding VTYPE)* | ('var' | 'let' | 'const') cvard (',' cvard)*
importeq = ID '=' ('require' '(' STR ')' | ID ('.' IDN)*) SEMI
indexsig = '[' ID ':' type ']' ':' type SEMI
type = utype ('extends' utype '?' type ':' type)? | functype
utype = ('|' | '&')? ptype (('|' | '&') ptype)*
ptype = ('keyof' | 'unique' | 'readonly' | 'infer')* atype ('[' type? ']')*
atype = typeref | STR | '-'? NUM | 'true' | 'false' | 'null' | 'void' | 'this' | template | objtype | tupletype | '(' type ')' | 'typeof' ID ('.' (IDN | PRIVATE))* typeargs? | 'typeof'? 'import' '(' type ')' ('.' IDN)* typeargs?
functype = 'abstract'? 'new'? TYPARAMS params '=>' rtype
rtype = type | (ID | 'this') 'is' type | 'asserts' (ID | 'this') ('is' type)?
typeref = ID ('.' IDN)* typeargs?
typeargs = '<' type (',' type)* ','? '>'
typarams = '<' typaram (',' typaram)* ','? '>'
typaram = 'const'? 'in'? 'out'? ID ('extends' type)? ('=' type)?
objtype = '{' (tmember (';' | ',' | ASI))* '}'
tmember = 'readonly'? propname '?'? (':' type)? | ('get' | 'set')? propname '?'? TYPARAMS params (':' rtype)? | 'new'? TYPARAMS params (':' rtype)?
  | ('+' | '-')? 'readonly'? '[' ID (':' type ']' ':' type | 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)?)
tupletype = '[' (telem (',' telem)* ','?)? ']'
telem = '...'? (IDN '?'? ':')? type '?'?
"""

_JS_PRIM = "ID | NUM | STR | REGEX | 'null' | 'true' | 'false' | 'this' | 'super' | array | template | '(' expr ')' | 'import' args | 'import' '.' IDN | 'new' '.' IDN | PRIVATE"


def _js_macros(ts: bool) -> dict[str, str]:
    ident = f"NAME | {_any(JS_CONTEXT)}"
    m = {
        "ID": ident,
        "IDN": f"{ident} | {_any(JS_RESERVED)}",
        "SEMI": "';' | ASI",
        "PREFIX": "'+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' | 'yield' '*'?" + (" | '<' type '>'" if ts else ""),
        "POSTFIX": "'.' (IDN | PRIVATE) | '?.' (IDN | PRIVATE | '[' expr ']' | args | template) | '[' expr ']' | args | template | '++' | '--'" + (" | '!' | typeargs" if ts else ""),
        "TAIL": "(binop operand | '?' assign ':' assign | asgop assign" + (" | ('as' | 'satisfies') type" if ts else "") + ")*",
        "PRIM": _JS_PRIM,
        "VTYPE": "(':' type)?" if ts else "()",
        "TSBANG": "'!'?" if ts else "()",
        "TSOPT": "'?'?" if ts else "()",
        "TSOPTBANG": "('?' | '!')?" if ts else "()",
        "TYPARAMS": "typarams?" if ts else "()",
        "RET": "(':' rtype)?" if ts else "()",
        "FBODY": "(block | SEMI)" if ts else "block",
        "PMOD": "(decorator | 'public' | 'private' | 'protected' | 'readonly' | 'override')*" if ts else "()",
        "PNAME": "((ID | 'this' | objpat | arrpat) '?'?)" if ts else "binding",
        "ABSTRACT": "'abstract'?" if ts else "()",
        "IMPLEMENTS": "('implements' typeref (',' typeref)*)?" if ts else "()",
        "MMOD": "('static' | 'async' | 'get' | 'set' | 'accessor'" + (" | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'" if ts else "") + ")",
        "TSINDEX": "| indexsig" if ts else "",
        "TSTYPE": "'type'?" if ts else "()",
        "TSDECL": "| interface | typealias | enum | namespace | declare" if ts else "",
        "TSIMPORT": "| 'import' 'type'? importeq" if ts else "",
        "TSEXPORT": "| interface | typealias | enum | namespace | declare | '=' expr SEMI | 'import' importeq | 'as' 'namespace' ID SEMI | 'type' '*' ('as' ID)? 'from' STR SEMI" if ts else "",
        "TSDEFAULT": "| interface" if ts else "",
    }
    # these stand inside alternatives, so they must not be wrapped in brackets
    return m


_BARE = ("TSINDEX", "TSDECL", "TSIMPORT", "TSEXPORT", "TSDEFAULT")


@cache
def _js(ts: bool) -> Grammar:
    macros = _js_macros(ts)
    rules = _rules(_JS + (_TS if ts else ""))
    for name, body in rules.items():
        for b in _BARE:
            body = body.replace(b, macros[b])
        rules[name] = body
    return Grammar(rules, {k: v for k, v in macros.items() if k not in _BARE})


# ---------------------------------------------------------------------------------------------------------------------
_PY = """
file = (NEWLINE | stmt)* EOF
stmt = simple | compound
simple = small (';' small)* ';'? NEWLINE
small = exprstmt | 'pass' | 'break' | 'continue' | 'del' stars | 'return' stars? | 'raise' (test ('from' test)?)? | ('global' | 'nonlocal') ID (',' ID)* | importstmt | 'assert' test (',' test)? | 'type' ID typarams? '=' test
exprstmt = stars (AUG (yieldexpr | stars) | ('=' (yieldexpr | stars))*) | target ':' test ('=' (yieldexpr | stars))? | yieldexpr
target = prim | '(' prim ')'
importstmt = 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)* | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | imports | '(' imports ','? ')')
imports = ID ('as' ID)? (',' ID ('as' ID)?)*
dotted = ID ('.' ID)*
compound = ifstmt | 'while' named ':' block elseblock? | 'async'? 'for' targets 'in' stars ':' block elseblock? | trystmt | 'async'? 'with' withitems ':' block | decorators? 'async'? funcdef | decorators? classdef | matchstmt
ifstmt = 'if' named ':' block ('elif' named ':' block)* elseblock?
elseblock = 'else' ':' block
trystmt = 'try' ':' block (('except' '*'? (test (',' test)* ('as' ID)?)? ':' block)+ elseblock? finallyblock? | finallyblock)
finallyblock = 'finally' ':' block
withitems = withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')'
withitem = test ('as' targetx)?
targets = targetx (',' targetx)* ','?
targetx = '*'? prim
decorators = ('@' named NEWLINE)+
funcdef = 'def' ID typarams? '(' params? ')' ('->' test)? ':' block
classdef = 'class' ID typarams? args? ':' block
typarams = '[' typaram (',' typaram)* ','? ']'
typaram = ('*' | '**')? ID (':' test)? ('=' '*'? test)?
params = param (',' param)* ','?
param = ID (':' '*'? test)? ('=' test)? | '*' (ID (':' '*'? test)?)? | '**' ID (':' test)? | '/'
block = simple | NEWLINE INDENT stmt+ DEDENT
matchstmt = 'match' stars ':' NEWLINE INDENT ('case' patterns ('if' named)? ':' block)+ DEDENT
patterns = pattern (',' pattern)* ','?
pattern = orpat ('as' ID)? | '*' ID
orpat = closedpat ('|' closedpat)*
closedpat = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted ('(' (patarg (',' patarg)* ','?)? ')')? | '(' patterns? ')' | '[' patterns? ']' | '{' (patitem (',' patitem)* ','?)? '}'
patarg = (ID '=')? pattern
patitem = ('-'? NUM | STR+ | 'None' | 'True' | 'False' | dotted) ':' pattern | '**' ID
yieldexpr = 'yield' ('from' test | stars)?
stars = star (',' star)* ','?
star = '*' ops | named
named = (ID ':=')? test
test = ops ('if' ops 'else' test)? | lambda
lambda = 'lambda' lparams? ':' test
lparams = lparam (',' lparam)* ','?
lparam = ID ('=' test)? | '*' ID? | '**' ID | '/'
ops = unary (OP unary)*
unary = ('not' | '-' | '+' | '~' | 'await')* prim
prim = atom (('.' ID) | args | subscript)*
atom = ID | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' (yieldexpr | star comp | stars)? ')' | '[' (star comp | stars)? ']' | '{' (dictorset)? '}'
dictorset = star comp | stars | test ':' test comp | ditem (',' ditem)* ','?
ditem = test ':' test | '**' ops
comp = ('async'? 'for' targets 'in' ops ('if' compif)*)+
compif = (ID ':=')? (ops | lambda)
args = '(' (arg (',' arg)* ','? | named comp)? ')'
arg = named | ID '=' test | '*' test | '**' test
subscript = '[' sub (',' sub)* ','? ']'
sub = '*' ops | named | test? ':' test? (':' test?)?
"""
_PY_MACROS = {
    "ID": "NAME | 'match' | 'case' | 'type' | '_'",
    "AUG": "'+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='",
    "OP": "'or' | 'and' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**'",
}

# ---------------------------------------------------------------------------------------------------------------------
_RUST = """
file = innerattr* item* EOF
innerattr = '#' '!' '[' tt* ']'
attr = '#' '[' tt* ']'
tt = '(' tt* ')' | '[' tt* ']' | '{' tt* '}' | ANY
item = attr* (vis? itemkind | macroitem)
vis = 'pub' ('(' ('crate' | 'self' | 'super' | 'in' spath) ')')?
itemkind = 'use' usetree ';' | 'unsafe'? 'mod' ID (';' | '{' innerattr* item* '}') | fn | struct | enum | constitem | static | trait | impl | typealias | externitem | 'macro' ID tt tt?
macroitem = spath '!' ID? ('{' tt* '}' | '(' tt* ')' ';' | '[' tt* ']' ';')
spath = '::'? seg ('::' seg)*
seg = ID | 'self' | 'super' | 'crate' | 'Self' | '$' 'crate'
usetree = '::'? (usegroup | seg ('::' seg)* ('::' usegroup | 'as' (ID | '_'))?)
usegroup = '*' | '{' (usetree (',' usetree)* ','?)? '}'
fn = FNQ* 'fn' ID gen? '(' fnparams? ')' ('->' type)? where? (block | ';')
fnparams = fnparam (',' fnparam)* ','?
fnparam = attr* (selfparam | pat ':' ('...' | type) | '...')
selfparam = ('&' LIFETIME?)? 'mut'? 'self' (':' type)?
struct = ('struct' | 'union') ID gen? (where? '{' fields? '}' | '(' tfields? ')' where? ';' | where? ';')
fields = sfield (',' sfield)* ','?
sfield = attr* vis? ID ':' type
tfields = tfield (',' tfield)* ','?
tfield = attr* vis? type
enum = 'enum' ID gen? where? '{' (variant (',' variant)* ','?)? '}'
variant = attr* vis? ID ('{' fields? '}' | '(' tfields? ')')? ('=' expr)?
constitem = 'const' (ID | '_') ':' type ('=' expr)? ';'
static = 'unsafe'? 'static' 'mut'? ID ':' type ('=' expr)? ';'
trait = 'unsafe'? 'auto'? 'trait' ID gen? (':' bounds?)? where? '{' innerattr* item* '}'
impl = 'unsafe'? 'impl' gen? 'const'? '!'? type ('for' type)? where? '{' innerattr* item* '}'
typealias = 'type' ID gen? (':' bounds?)? where? ('=' type)? where? ';'
externitem = 'extern' 'crate' (ID | 'self') ('as' (ID | '_'))? ';' | 'unsafe'? 'extern' STR? '{' innerattr* item* '}'
gen = '<' (gparam (',' gparam)* ','?)? '>'
gparam = attr* (LIFETIME (':' bounds?)? | ID (':' bounds?)? ('=' type)? | 'const' ID ':' type ('=' (block | lit))?)
bounds = bound ('+' bound)* '+'?
bound = LIFETIME | ('?' | '~' 'const')? ('for' gen)? tpath | '(' '?'? ('for' gen)? tpath ')' | 'use' gen
where = 'where' wpred (',' wpred)* ','? | 'where'
wpred = LIFETIME ':' bounds? | ('for' gen)? type ':' bounds?
type = '(' (type (',' type)* ','?)? ')' | '!' | ('&' | '&&') LIFETIME? 'mut'? type | '*' ('const' | 'mut') type | '[' type (';' expr)? ']' | '_' | ('for' gen)? FNQ* 'fn' '(' (farg (',' farg)* ','?)? ')' ('->' type)? | ('impl' | 'dyn') bounds | tpath ('!' tt)? | qpath | 'for' gen tpath
farg = attr* ((ID | '_') ':')? type | '...'
qpath = '<' type ('as' tpath)? '>' ('::' tseg)+
tpath = '::'? tseg ('::' tseg)*
tseg = seg ('::'? gargs | '(' (type (',' type)* ','?)? ')' ('->' type)?)?
gargs = '<' (garg (',' garg)* ','?)? '>'
garg = LIFETIME | type | lit | block | ID gargs? ('=' type | ':' bounds)
lit = '-'? NUM | STR | CHAR | 'true' | 'false'
block = '{' innerattr* stmt* expr? '}'
stmt = ';' | attr* let | item | attr* blocklike | attr* expr ';'
let = 'let' pat (':' type)? ('=' expr ('else' block)?)? ';'
blocklike = block | 'unsafe' block | 'const' block | 'async' 'move'? block | ifexpr | match | LABEL? 'loop' block | LABEL? 'while' nexpr block | LABEL? 'for' pat 'in' nexpr block | LIFETIME ':' block | spath '!' '{' tt* '}'
ifexpr = 'if' nexpr block ('else' (ifexpr | block))?
match = 'match' nexpr '{' innerattr* arm* lastarm? '}'
arm = armhead (expr ',' | blocklike ','?)
lastarm = armhead expr
armhead = attr* pat ('if' expr)? '=>'
expr = operand TAIL | RANGE (operand TAIL)?
nexpr = noperand NTAIL | RANGE (noperand NTAIL)?
operand = PREFIX* primary POST* | jump | attr operand
noperand = PREFIX* nprimary POST* | jump
jump = 'return' expr? | 'break' LIFETIME? expr? | 'continue' LIFETIME? | 'yield' expr?
primary = PRIM | epath structlit?
nprimary = PRIM | epath
epath = '::'? eseg ('::' eseg)* | '<' type ('as' tpath)? '>' ('::' eseg)+
eseg = seg | gargs
structlit = '{' ((finit (',' finit)* ','?)? | (finit ',')* '..' expr?) '}'
finit = attr* (ID | NUM) (':' expr)?
closure = 'static'? 'async'? 'move'? ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' type block | expr)
cparam = attr* patone (':' type)?
args = '(' (expr (',' expr)* ','?)? ')'
pat = '|'? patone ('|' patone)*
patone = '_' | '..' | ('&' | '&&') 'mut'? patone | 'ref'? 'mut'? ID ('@' patone)? | pathpat ('(' pats? ')' | '{' fpats? '}')? | '(' pats? ')' | '[' pats? ']' | patlit (('..=' | '..' | '...') (patlit | pathpat)?)? | pathpat ('..=' | '..' | '...') (patlit | pathpat)? | ('..=') (patlit | pathpat) | spath '!' tt | 'box' patone | 'const' block
pathpat = epath
patlit = lit
pats = pat (',' pat)* ','?
fpats = fpat (',' fpat)* ','?
fpat = attr* ('..' | 'ref'? 'mut'? ID | (ID | NUM) ':' pat)
"""
_RUST_PUNCT = "... ..= <<= .. :: -> => == != <= >= && || += -= *= /= %= ^= &= |= << ; . , < > + - * / % & | ^ ! ? : = @ # $ ~".split()
_RUST_MACROS = {
    "ID": "NAME | 'union' | 'auto' | 'macro_rules' | 'safe'",
    "ANY": f"NAME | NUM | STR | CHAR | LIFETIME | '_' | 'union' | 'auto' | 'macro_rules' | 'safe' | {_any(RUST_KEYWORDS)} | {_any(_RUST_PUNCT)}",
    "FNQ": "'const' | 'async' | 'unsafe' | 'safe' | 'extern' STR?",
    "LABEL": "LIFETIME ':'",
    "RANGE": "'..' | '..='",
    "PREFIX": "'-' | '*' | '!' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw'? ('const' | 'mut')",
    "POST": "'?' | '.' (ID ('::' gargs)? | NUM | 'await' | 'match') | args | '[' expr ']'",
    "BINOP": "'+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '<<' | '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>' '>='",
    "TAIL": "(BINOP operand | RANGE operand? | 'as' type)*",
    "NTAIL": "(BINOP noperand | RANGE noperand? | 'as' type)*",
    "PRIM": "lit | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (',' expr)* ','? | expr ';' expr)? ']' | blocklike | closure | spath '!' ('(' tt* ')' | '[' tt* ']') | 'let' pat '=' noperand | '_'",
}

# ---------------------------------------------------------------------------------------------------------------------
_GO = """
file = 'package' NAME ';' (importdecl ';')* (topdecl ';')* EOF
importdecl = 'import' (ispec | '(' (ispec (';' ispec)* ';'?)? ')')
ispec = ('.' | NAME)? STR
topdecl = decl | funcdecl
decl = 'const' (cspec | '(' (gcspec (';' gcspec)* ';'?)? ')') | 'var' (vspec | '(' (vspec (';' vspec)* ';'?)? ')') | 'type' (tspec | '(' (tspec (';' tspec)* ';'?)? ')')
cspec = names type? '=' exprs
gcspec = names (type? '=' exprs)?
vspec = names (type ('=' exprs)? | '=' exprs)
tspec = NAME typarams? '='? type
names = NAME (',' NAME)*
typarams = '[' tparam (',' tparam)* ','? ']'
tparam = names union
union = '~'? type ('|' '~'? type)*
funcdecl = 'func' params? NAME typarams? sig block?
sig = params (params | type)?
params = '(' (pdecl (',' pdecl)* ','?)? ')'
pdecl = NAME '...'? type | '...'? type
type = tname | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | struct | interface | '(' type ')'
tname = NAME ('.' NAME)? ('[' type (',' type)* ','? ']')?
struct = 'struct' '{' (sfield (';' sfield)* ';'?)? '}'
sfield = (names type | '*'? tname) STR?
interface = 'interface' '{' (ielem (';' ielem)* ';'?)? '}'
ielem = NAME sig | union
block = '{' ';'* (stmt (';'+ stmt)* ';'*)? '}'
stmts = ';'* stmt (';'+ stmt)* ';'* | ';'+
stmt = decl | NAME ':' stmt? | simple | ('go' | 'defer') expr | 'return' exprs? | ('break' | 'continue') NAME? | 'goto' NAME | 'fallthrough' | block | ifstmt | 'switch' switchhead? '{' clause* '}' | 'select' '{' comm* '}' | forstmt
simple = exprs (ASG exprs | ':=' exprs | '++' | '--' | '<-' expr)?
nsimple = nexprs (ASG nexprs | ':=' nexprs | '++' | '--' | '<-' nexpr)?
ifstmt = 'if' (nsimple? ';')? nexpr block ('else' (ifstmt | block))?
switchhead = nsimple? ';' nsimple? | nsimple
clause = ('case' exprs | 'default') ':' stmts?
comm = ('case' simple | 'default') ':' stmts?
forstmt = 'for' (nexpr | nsimple? ';' nexpr? ';' nsimple? | (nexprs ('=' | ':='))? 'range' nexpr)? block
exprs = expr (',' expr)*
nexprs = nexpr (',' nexpr)*
expr = operand (BINOP operand)*
nexpr = noperand (BINOP noperand)*
operand = UNARY* (NAME | PRIM) (POST | complit)*
noperand = UNARY* (NAME | PRIM) POST*
typelit = ('[' (expr | '...')? ']' type | 'map' '[' type ']' type | struct)
complit = '{' (celem (',' celem)* ','?)? '}'
celem = (expr | complit) (':' (expr | complit))?
args = '(' (expr (',' expr)* '...'? ','?)? ')'
index = '[' (expr (',' expr)* ','? | expr? ':' expr? (':' expr)?) ']'
"""
_GO_MACROS = {
    "ASG": "'=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='",
    "BINOP": "'||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'",
    "UNARY": "'+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~'",
    "PRIM": "NUM | STR | CHAR | '(' expr ')' | 'func' sig block? | typelit complit? | 'chan' '<-'? type | interface",
    "POST": "'.' (NAME | '(' (type | 'type') ')') | index | args",
}

_JSON = """
file = value EOF
value = STR | NUM | 'true' | 'false' | 'null' | '{' (pair (',' pair)*)? '}' | '[' (value (',' value)*)? ']'
pair = STR ':' value
"""


@cache
def grammar(language: str) -> Grammar:
    if language in ("ts", "js"):
        return _js(language == "ts")
    text, macros = {"py": (_PY, _PY_MACROS), "rs": (_RUST, _RUST_MACROS), "go": (_GO, _GO_MACROS), "json": (_JSON, {})}[language]
    return Grammar(_rules(text), macros)


__all__ = ["grammar", "GO_KEYWORDS", "PY_KEYWORDS"]
