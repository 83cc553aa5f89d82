"""Grammars of the supported languages, written for ``gll.Grammar``.

Precedence is left out, as only acceptance counts: an operand list with operators between is one rule.
A grammar may have several start rules, which a parse runs together.
"""

from __future__ import annotations

PYTHON = r"""
module: (NEWLINE | stmt)* EOF ;
stmt: simple_line | compound ;
simple_line: simple (';' simple)* ';'? NEWLINE ;
block: simple_line | NEWLINE INDENT stmt+ DEDENT ;
name: NAME | 'match' | 'case' | 'type' ;
simple: 'pass' | 'break' | 'continue' | 'return' starlist? | 'raise' (test ('from' test)?)? | ('global' | 'nonlocal') name (',' name)*
  | 'del' starlist | 'assert' test (',' test)? | import | 'type' name typarams? '=' test
  | starlist (':' test ('=' value)? | augop value | ('=' value)*) | yield ;
value: starlist | yield ;
augop: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
import: 'import' dotted ('as' name)? (',' dotted ('as' name)?)*
  | 'from' ('.' | '...')* dotted? 'import' ('*' | '(' aliases ','? ')' | aliases) ;
aliases: name ('as' name)? (',' name ('as' name)?)* ;
dotted: name ('.' name)* ;
compound: 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
  | 'while' named ':' block ('else' ':' block)?
  | 'async'? 'for' starlist 'in' starlist ':' block ('else' ':' block)?
  | 'try' ':' block (('except' '*'? (test (',' test)* ('as' name)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block)
  | 'async'? 'with' (withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')') ':' block
  | ('@' named NEWLINE)* (funcdef | classdef)
  | 'match' starlist ':' NEWLINE INDENT ('case' patterns ('if' named)? ':' block)+ DEDENT ;
withitem: test ('as' starone)? ;
funcdef: 'async'? 'def' name typarams? '(' params? ')' ('->' starlist)? ':' block ;
classdef: 'class' name typarams? ('(' args? ')')? ':' block ;
typarams: '[' typaram (',' typaram)* ','? ']' ;
typaram: ('*' | '**')? name (':' test)? ('=' test)? ;
params: param (',' param)* ','? ;
param: '/' | '*' (name (':' starone)?)? | '**' name (':' test)? | name (':' test)? ('=' test)? ;
lparams: lparam (',' lparam)* ','? ;
lparam: '/' | '*' name? | '**' name | name ('=' test)? ;
starlist: starone (',' starone)* ','? ;
starone: '*' test | named ;
named: test (':=' test)? ;
yield: 'yield' ('from' test | starlist)? ;
test: operands ('if' operands 'else' test)? | 'lambda' lparams? ':' test ;
operands: operand (binop operand)* ;
binop: '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '&' | '|' | '^' | '<<' | '>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'? ;
operand: ('-' | '+' | '~' | 'not' | 'await')* atom trailer* ;
atom: name | NUMBER | STRING+ | '...' | 'None' | 'True' | 'False'
  | '(' (yield | starone (comp | (',' starone)* ','?))? ')'
  | '[' (starone (comp | (',' starone)* ','?))? ']'
  | '{' (entry (comp | (',' entry)* ','?))? '}' ;
entry: '**' operands | test ':' test | starone ;
comp: ('async'? 'for' starlist_in 'in' operands2 ('if' cond)*)+ ;
starlist_in: target (',' target)* ','? ;
target: '*'? operand_t ;
operand_t: atom trailer* ;
operands2: test | operands ;
cond: named | operands ;
trailer: '(' args? ')' | '[' subscript (',' subscript)* ','? ']' | '.' name ;
args: arg (',' arg)* ','? ;
arg: '*' test | '**' test | named comp? | name '=' test ;
subscript: starone | test? ':' test? (':' test?)? ;
patterns: pattern (',' pattern)* ','? ;
pattern: ('*' name | alt) ('as' name)? ;
alt: closed ('|' closed)* ;
closed: '-'? NUMBER (('+' | '-') NUMBER)? | STRING+ | 'None' | 'True' | 'False' | dotted ('(' (parg (',' parg)* ','?)? ')')?
  | '(' patterns? ')' | '[' patterns? ']' | '{' (pentry (',' pentry)* ','?)? '}' ;
parg: pattern | name '=' pattern ;
pentry: '**' name | (closed) ':' pattern ;
"""

JSON = r"""
json: value EOF ;
value: STRING | NUMBER | 'true' | 'false' | 'null' | '{' (STRING ':' value (',' STRING ':' value)*)? '}' | '[' (value (',' value)*)? ']' ;
"""

# ECMAScript modules; the predicate ``@TS`` lets the rules of TypeScript in, for files of its suffixes.
SCRIPT = r"""
module: item* EOF ;
item: import | export | stmt ;
name: NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'from' | 'as' | 'let' | 'type' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'override' | 'is' | 'asserts' | 'keyof' | 'unique' | 'infer'
  | 'satisfies' | 'global' | 'out' ;
word: name | 'interface' | 'public' | 'private' | 'protected' | 'implements' | 'import' | 'export' | 'default' | 'function' | 'class' | 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'break' | 'continue' | 'throw' | 'try' | 'catch' | 'finally'
  | 'switch' | 'case' | 'var' | 'const' | 'new' | 'delete' | 'typeof' | 'void' | 'in' | 'instanceof' | 'this' | 'super' | 'null' | 'true' | 'false' | 'yield' | 'await' | 'extends' | 'with' | 'debugger' | 'enum' ;
semi: ';' | @ASI ;
import: 'import' (STRING | @TS 'type' clause 'from' STRING | clause 'from' STRING | @TS name '=' expr) attributes? semi ;
attributes: ('with' | 'assert') object ;
clause: name (',' (named | '*' 'as' name))? | named | '*' 'as' name ;
named: '{' (spec (',' spec)* ','?)? '}' ;
spec: (@TS 'type')? (word | STRING) ('as' (word | STRING))? ;
export: 'export' (@TS 'type')? ('*' ('as' (word | STRING))? 'from' STRING attributes? semi | named ('from' STRING attributes?)? semi)
  | 'export' 'default' (function | class | @PLAIN assign semi | @TS interface) | 'export' (declaration | @TS '=' expr semi) ;
declaration: vars semi | function | class | @TS tsdecl ;
vars: ('var' | 'let' | 'const') bind (',' bind)* ;
bind: target (@TS '!')? annot? ('=' assign)? ;
target: name | '{' (prop (',' prop)* ','?)? '}' | '[' (elem? ',')* elem? ']' ;
prop: '...' target | key ':' target ('=' assign)? | name ('=' assign)? ;
elem: '...'? target ('=' assign)? ;
annot: @TS ':' type ;
function: 'async'? 'function' '*'? name? typars? '(' params? ')' result? (body | @TS semi) ;
result: @TS ':' (name 'is' type | 'asserts' name ('is' type)? | type) ;
body: '{' stmt* '}' ;
params: param (',' param)* ','? ;
param: decorator* modifier* '...'? (target | @TS 'this') (@TS '?')? annot? ('=' assign)? ;
modifier: @TS ('public' | 'private' | 'protected' | 'readonly' | 'override') ;
decorator: '@' name ('.' word)* targs? ('(' args? ')')? ;
class: decorator* (@TS 'abstract')? 'class' name? typars? ('extends' operand targs?)? (@TS 'implements' type (',' type)*)? '{' member* '}' ;
member: ';' | 'static' body | decorator* mod* ( 'async'? '*'? key (@TS '?')? typars? '(' params? ')' result? (body | @TS semi)
  | ('get' | 'set') key '(' params? ')' result? (body | @TS semi) | key (@TS ('?' | '!'))? annot? ('=' assign)? semi | @TS '[' name ':' type ']' annot semi ) ;
mod: 'static' | @TS ('public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare') ;
key: word | STRING | NUMBER | PRIVATE | '[' assign ']' ;
stmt: body | ';' | declaration | @PLAIN expr semi | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'?
  | 'for' 'await'? '(' ((vars | expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') target annot? | operand) ('of' assign | 'in' expr)) ')' stmt
  | 'return' (@SAME expr)? semi | ('break' | 'continue') (@SAME name)? semi | 'throw' @SAME expr semi | 'debugger' semi
  | 'try' body ('catch' ('(' target annot? ')')? body ('finally' body)? | 'finally' body)
  | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* '}' | name ':' stmt ;
expr: assign (',' assign)* ;
assign: arrow | 'yield' ('*' assign | assign)? | operands ('?' assign ':' assign)? (asop assign)? ;
asop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
arrow: 'async'? (name | typars? '(' params? ')' result?) '=>' (body | @NOBRACE assign) ;
operands: operand (binop operand | @TS ('as' | 'satisfies') type)* ;
binop: '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof' ;
operand: ('+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new')* primary post* (@SAMELINE ('++' | '--'))? ;
post: '.' (word | PRIVATE) | '?.' (word | PRIVATE | '(' args? ')' | '[' expr ']') | '[' expr ']' | '(' args? ')' | template | @TS '!' | targs ('(' args? ')' | template) ;
primary: name | NUMBER | STRING | REGEX | template | 'this' | 'super' | 'null' | 'true' | 'false' | PRIVATE | array | object | function_e | class | '(' expr ')'
  | 'import' ('(' args ')' | '.' word) | @NEWTARGET '.' word ;
function_e: 'async'? 'function' '*'? name? typars? '(' params? ')' result? body ;
template: TEMPLATE | THEAD expr (TMID expr)* TTAIL ;
array: '[' (',' | '...'? assign (',' | @CLOSE))* ']' ;
object: '{' (entry (',' entry)* ','?)? '}' ;
entry: '...' assign | key ':' assign | name ('=' assign)? | 'async'? '*'? key typars? '(' params? ')' result? body | ('get' | 'set') key '(' params? ')' result? body ;
args: '...'? assign (',' '...'? assign)* ','? ;
targs: @TS '<' type (',' type)* '>' ;
typars: @TS '<' typar (',' typar)* ','? '>' ;
typar: ('const' | 'in' | 'out')? name ('extends' type)? ('=' type)? ;
interface: 'interface' name typars? ('extends' type (',' type)*)? shape ;
tsdecl: interface | 'type' name typars? '=' type semi | 'const'? 'enum' name '{' (key ('=' assign)? (',' key ('=' assign)?)* ','?)? '}'
  | ('namespace' | 'module') (name ('.' name)* | STRING) '{' item* '}' | 'declare' (declaration | 'global' '{' item* '}' | 'module' STRING semi) ;
shape: '{' (field (';' | ',' | @ASI))* '}' ;
field: mod* key '?'? (annot | typars? '(' params? ')' result?)? | ('get' | 'set') key '(' params? ')' result? | 'new'? typars? '(' params? ')' result? | ('+' | '-')? 'readonly'? '[' name (':' type | 'in' type ('as' type)?) ']' ('+' | '-')? '?'? annot? ;
type: '|'? typeand ('|' typeand)* ('extends' type '?' type ':' type)? | 'abstract'? 'new'? typars? '(' params? ')' '=>' (name 'is' type | type) ;
typeand: '&'? typeone ('&' typeone)* ;
typeone: ('keyof' | 'readonly' | 'unique' | 'infer')? typeatom (@SAMELINE '[' type? ']')* ;
typeatom: (word ('.' word)*) ('<' type (',' type)* '>')? | STRING | '-'? NUMBER | template | shape | '[' (tuple (',' tuple)* ','?)? ']' | '(' type ')' | 'typeof'? 'import' '(' STRING ')' ('.' word)* | 'typeof' name ('.' word)* ;
tuple: '...'? (name '?'? ':')? type '?'? ;
"""

GO = r"""
file: 'package' NAME ';' (import ';')* (decl ';')* EOF ;
import: 'import' (spec | '(' (spec ';')* spec? ')') ;
spec: (NAME | '.')? STRING ;
decl: 'func' receiver? NAME typars? signature block? | gen ;
gen: 'var' (varspec | '(' (varspec ';')* varspec? ')') | 'const' (constspec | '(' (constspec ';')* constspec? ')') | 'type' (typespec | '(' (typespec ';')* typespec? ')') ;
varspec: names (type ('=' exprs)? | '=' exprs) ;
constspec: names (type? '=' exprs)? ;
typespec: NAME typars? '='? type ;
names: NAME (',' NAME)* ;
receiver: '(' NAME? type ','? ')' ;
typars: '[' names constraint (',' names constraint)* ','? ']' ;
constraint: '~'? type ('|' '~'? type)* ;
signature: '(' params? ')' result? ;
result: type | '(' params? ')' ;
params: param (',' param)* ','? ;
param: NAME? '...'? type ;
type: NAME ('.' NAME)? ('[' type (',' type)* ','? ']')? | '*' type | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' signature
  | 'struct' '{' (field ';')* field? '}' | 'interface' '{' (method ';')* method? '}' | '(' type ')' ;
field: (names type | '*'? NAME ('.' NAME)? ('[' type ']')?) STRING? ;
method: NAME signature | constraint ;
block: '{' stmts '}' ;
stmts: (stmt? ';')* stmt? ;
stmt: gen | simple | block | 'return' exprs? | ('break' | 'continue') NAME? | 'goto' NAME | 'fallthrough' | 'go' expr | 'defer' expr | NAME ':' stmt? | if
  | 'for' (range | (simple? ';' expr? ';' simple? | expr)?) block | 'switch' (simple? ';')? simple? '{' clause* '}' | 'select' '{' comm* '}' ;
range: (exprs ('=' | ':='))? 'range' expr ;
if: 'if' (simple? ';')? expr block ('else' (if | block))? ;
clause: ('case' casex (',' casex)* | 'default') ':' stmts ;
casex: expr | type ;
comm: ('case' simple | 'default') ':' stmts ;
simple: exprs (('=' | ':=' | asop) exprs | '++' | '--' | '<-' expr)? ;
asop: '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
exprs: expr (',' expr)* ;
expr: operand (binop operand)* ;
binop: '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '<-' ;
operand: ('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~')* primary post* ;
primary: NAME | NUMBER | STRING | CHAR | '(' (expr | type) ')' | 'func' signature block | ltype literal | ltype '(' expr ')' | 'func' signature '(' expr ')' ;
ltype: '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'struct' '{' (field ';')* field? '}' | 'interface' '{' '}' | 'chan' type ;
post: '.' (NAME | '(' (type | 'type') ')') | '[' (expr? ':' expr? (':' expr)? | typex (',' typex)* ','?) ']' | '(' (arg (',' arg)* ','?)? ')' | literal ;
typex: expr | type ;
arg: (expr | type) '...'? ;
literal: '{' (elem (',' elem)* ','?)? '}' ;
elem: (expr | literal) (':' (expr | literal))? ;
"""

JAVA = r"""
file: annotation* ('package' qname ';')? (import | ';')* (typedecl | ';')* EOF ;
import: 'import' 'static'? qname ('.' '*')? ';' ;
name: NAME | 'record' | 'var' | 'yield' | 'sealed' | 'permits' | 'module' ;
qname: name ('.' name)* ;
annotation: '@' qname ('(' (avalue (',' avalue)* ','?)? ')')? ;
avalue: (name '=')? (ternary | annotation | '{' (avalue (',' avalue)* ','?)? '}') ;
mods: (annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed')* ;
typedecl: mods typebody ;
typebody: 'class' name typars? ('extends' type)? ('implements' types)? ('permits' types)? '{' member* '}'
  | 'interface' name typars? ('extends' types)? ('permits' types)? '{' member* '}' | '@' 'interface' name '{' member* '}'
  | 'enum' name ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}'
  | 'record' name typars? '(' params? ')' ('implements' types)? '{' member* '}' ;
constant: annotation* name ('(' args? ')')? ('{' member* '}')? ;
types: type (',' type)* ;
typars: '<' typar (',' typar)* '>' ;
typar: annotation* name ('extends' type ('&' type)*)? ;
member: ';' | 'static'? block | mods (typebody | typars? (type | 'void') name '(' params? ')' dims ('throws' types)? (block | ('default' avalue)? ';')
  | typars? name '(' params? ')' ('throws' types)? block | name block | type declarators ';') ;
declarators: declarator (',' declarator)* ;
declarator: name dims ('=' init)? ;
init: expr | '{' (init (',' init)* ','?)? '}' ;
dims: (annotation* '[' ']')* ;
params: param (',' param)* ;
param: mods type annotation* '...'? (name | name? 'this') dims ;
type: annotation* (prim | cname) dims ;
prim: 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' ;
cname: name targs? ('.' annotation* name targs?)* ;
targs: '<' (targ (',' targ)*)? '>' ;
targ: type | annotation* '?' (('extends' | 'super') type)? ;
block: '{' stmt* '}' ;
stmt: block | ';' | local ';' | expr ';' | typedecl | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' ((local | exprs)? ';' expr? ';' exprs? | mods type name dims ':' expr) ')' stmt | 'return' expr? ';' | 'break' name? ';' | 'continue' name? ';' | 'throw' expr ';' | 'yield' expr ';'
  | 'assert' expr (':' expr)? ';' | 'synchronized' '(' expr ')' block | 'try' ('(' resource (';' resource)* ';'? ')' block catches? | block catches) | switch | name ':' stmt ;
catches: ('catch' '(' mods type ('|' type)* name ')' block)+ ('finally' block)? | 'finally' block ;
resource: mods type name '=' expr | expr ;
local: mods type declarators ;
switch: 'switch' '(' expr ')' '{' group* '}' ;
group: ('case' label (',' label)* ('when' expr)? | 'default') (':' stmt* | '->' (expr ';' | block | 'throw' expr ';')) ;
label: ternary | 'default' | pattern ;
pattern: mods type name | type '(' (pattern (',' pattern)*)? ')' name? ;
exprs: expr (',' expr)* ;
expr: lambda | ternary (asop expr)? ;
asop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>=' ;
lambda: (name | '(' (params | name (',' name)*)? ')') '->' (expr | block) ;
ternary: operands ('?' (lambda | ternary) ':' (lambda | ternary))? ;
operands: operand (binop operand | 'instanceof' ('final'? type name? | pattern))* ;
binop: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||' ;
operand: ('+' | '-' | '!' | '~' | '++' | '--')* (primary post* ('++' | '--')* | '(' type ('&' type)* ')' (operand | lambda)) ;
primary: name ('(' args? ')')? | NUMBER | STRING | CHAR | TEXT | 'this' ('(' args? ')')? | 'super' ('(' args? ')')? | 'null' | 'true' | 'false' | '(' expr ')' | new | switch
  | (prim | 'void') dims ('.' 'class' | '::' 'new') | cname dims '::' ('new' | targs? name) | name ('.' name)* '[' ']' dims '.' 'class' ;
new: 'new' annotation* (cname targs? '(' args? ')' ('{' member* '}')? | (prim | cname) (('[' expr ']')+ dims | ('[' ']')+ init)) ;
post: '.' (targs? name ('(' args? ')')? | 'this' | 'super' ('(' args? ')')? | 'class' | new) | '[' expr ']' | '::' targs? (name | 'new') ;
args: expr (',' expr)* ;
"""

C = r"""
file: (external | ';')* EOF ;
external: specs declarator attr* block | specs idecls? ';' | declarator block | 'asm' '(' STRING+ ')' ';' | '_Static_assert' '(' ternary (',' STRING+)? ')' ';' ;
idecls: idecl (',' idecl)* ;
idecl: declarator attr* ('=' init)? | declarator? ':' ternary ;
attr: '__attribute__' '(' '(' (attrone (',' attrone)*)? ')' ')' | 'asm' '(' STRING+ ')' ;
attrone: (NAME | 'const') ('(' args? ')')? ;
specs: (storage)* (NAME | TYPE+ | aggregate | 'typeof' '(' (expr | typename) ')') storage* (TYPE | storage)* ;
storage: 'typedef' | 'extern' | 'static' | 'auto' | 'register' | 'inline' | 'const' | 'volatile' | 'restrict' | '_Noreturn' | '_Thread_local' | '_Atomic' | attr ;
aggregate: ('struct' | 'union') attr* (NAME? '{' (specs idecls? ';' | ';')* '}' attr* | NAME) | 'enum' (NAME? '{' NAME ('=' ternary)? (',' NAME ('=' ternary)?)* ','? '}' | NAME) ;
declarator: ('*' qual*)* direct ;
qual: 'const' | 'volatile' | 'restrict' | '_Atomic' ;
direct: (NAME | '(' attr* declarator ')') suffix* ;
suffix: '[' ('static' | qual)* (assign | '*')? ']' | '(' (params | NAME (',' NAME)*)? ')' ;
params: param (',' param)* (',' '...')? ;
param: specs (declarator | abstract)? ;
abstract: ('*' qual*)+ adirect? | adirect ;
adirect: ('(' abstract ')')? asuffix+ | '(' abstract ')' ;
asuffix: '[' ('static' | qual)* (assign | '*')? ']' | '(' params? ')' ;
typename: specs abstract? ;
block: '{' stmt* '}' ;
stmt: block | ';' | specs idecls? ';' | expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (specs idecls ';' | expr? ';') expr? ';' expr? ')' stmt | 'return' expr? ';' | 'break' ';' | 'continue' ';' | 'goto' ('*' expr | NAME) ';'
  | 'switch' '(' expr ')' stmt | 'case' ternary ('...' ternary)? ':' | 'default' ':' | NAME ':' attr* | 'asm' qual* '(' STRING+ (':' (asmop (',' asmop)*)?)* ')' ';' ;
asmop: ('[' NAME ']')? STRING ('(' expr ')')? ;
expr: assign (',' assign)* ;
assign: ternary (asop assign)? ;
asop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' ;
ternary: operands ('?' expr? ':' assign)? ;
operands: operand (binop operand)* ;
binop: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '&' | '|' | '^' | '&&' | '||' ;
operand: ('+' | '-' | '!' | '~' | '*' | '&' | '&&' | '++' | '--' | 'sizeof' | '_Alignof' | '(' typename ')')* (primary post* | 'sizeof' '(' typename ')') ;
primary: NAME | NUMBER | STRING+ | (STRING | NAME)+ | CHAR | '(' expr ')' | '(' block ')' | '(' typename ')' braces | '_Generic' '(' assign (',' (typename | 'default') ':' assign)+ ')' ;
post: '[' expr ']' | '(' args? ')' | '.' NAME | '->' NAME | '++' | '--' ;
args: arg (',' arg)* ;
arg: assign | typename ;
init: assign | braces ;
braces: '{' (elem (',' elem)* ','?)? '}' ;
elem: (('[' ternary ('...' ternary)? ']' | '.' NAME)+ '=' | NAME ':')? init ;
"""

SHELL = r"""
script: list? NL* EOF ;
sub: list? NL* EOF ;
list: NL* andor ((';' | '&' | NL) NL* andor)* (';' | '&' | NL)? ;
andor: pipeline (('&&' | '||') NL* pipeline)* ;
pipeline: ('!' | 'time')* command (('|' | '|&') NL* command)* | '!' ;
body: list NL* ;
command: simple | compound redirect* | func ;
compound: 'if' body 'then' body ('elif' body 'then' body)* ('else' body)? 'fi' | ('while' | 'until') body 'do' body 'done'
  | ('for' | 'select') anyword (NL* 'in' (anyword)* )? (';' | NL)? NL* ('do' body 'done' | '{' body '}') | 'for' ARITH ';'? NL* ('do' body 'done' | '{' body '}')
  | 'case' anyword NL* 'in' NL* (arm NL*)* lastarm? 'esac' | '{' body '}' | '(' body ')' | ARITH | COND ;
arm: '('? anyword ('|' anyword)* ')' NL* body? (';;' | ';&' | ';;&') ;
lastarm: '('? anyword ('|' anyword)* ')' NL* body? ;
func: (WORD | ASSIGN) '(' ')' NL* compound redirect* | 'function' anyword ('(' ')')? NL* compound redirect* | 'coproc' anyword? (compound | simple) redirect* ;
simple: (assign | redirect)+ (WORD rest*)? | WORD rest* ;
rest: anyword | redirect | ASSIGN array | '!' ;
assign: ASSIGN array? ;
array: '(' (anyword | ASSIGN array? | NL)* ')' ;
anyword: WORD | ASSIGN | 'if' | 'then' | 'elif' | 'else' | 'fi' | 'while' | 'until' | 'do' | 'done' | 'for' | 'select' | 'case' | 'in' | 'esac' | 'function' | 'coproc' | 'time' | '{' | '}' | '!' ;
redirect: REDIRECT (anyword) | HEREDOC ;
"""

YAML = r"""
stream: document? (DOCSTART document? | DOCEND)* EOF ;
document: node ;
node: PROP* content | PROP+ ;
content: SCALAR | ALIAS | BLOCKTEXT | flow | MAP (pair)* END | SEQ (DASH node?)* END ;
pair: KEY node? VALUE vnode? | KEY node? | VALUE vnode? ;
vnode: node | PROP* (DASH node?)+ ;
flow: '[' (fitem (',' fitem)* ','?)? ']' | '{' (fpair (',' fpair)* ','?)? '}' ;
fitem: fnode (':' fnode?)? | ':' fnode? | '?' fnode (':' fnode?)? ;
fpair: fnode (':' fnode?)? | ':' fnode? | '?' fnode (':' fnode?)? ;
fnode: PROP* (SCALAR | ALIAS | flow) | PROP+ ;
"""
