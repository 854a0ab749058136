"""TeX commands: token class, kind, grammar terminal and symbol of each.

A row is (class, kind, terminal, names). Kinds: C and N are operators whose operands commute
or don't, L is a leaf. ``name=symbol`` gives a command a symbol other than its own name;
``@symbol`` stands for spellings that aren't commands, which the lexer knows.
"""

from __future__ import annotations

ROWS = (
    ("ADD", "C", "ADD", "@plus @pm oplus uplus dotplus pm mp"),
    ("NEG", "C", "NEG", "@minus neg ominus setminus backslash smallsetminus lnot barwedge"),
    ("STAR", "L", "VAR", "ast @ast"),
    ("TIMES", "C", "TIMES", "times cdot=times otimes ltimes rtimes odot"),
    ("FRAC", "N", "DIV", "@frac div=frac divideontimes"),
    ("FRAC", "N", "ABOVE", "above=frac"),
    ("FRAC", "N", "FRAC", "frac dfrac=frac cfrac=frac tfrac=frac"),
    ("TAB_ROW", "C", "TAB_ROW", "@row"),
    ("TAB_COL", "C", "TAB_COL", "@column"),
    ("BINOM", "N", "CHOOSE", "choose=binom brack=binom"),
    ("BINOM", "N", "BINOM", "dbinom=binom tbinom=binom binom"),
    ("ROOT", "N", "SQRT", "sqrt=root"),
    ("ROOT", "N", "ROOT", "root"),
    ("MODULAR", "N", "MODULAR", "pmod=mod bmod=mod mod pod=mod"),
    ("VECT", "N", "VECT", "vec=rvect overrightarrow=rvect overleftarrow=lvect"),
    ("FACT", "N", "FACT", "@fact"),
    ("PRIME", "N", "PRIME", "@prime"),
    ("PRIME", "L", "VAR", "prime"),
    ("SUBSCRIPT", "C", "SUBSCRIPT", "@subscript"),
    ("SUPSCRIPT", "C", "SUPSCRIPT", "@supscript"),
    (
        "VAR",
        "L",
        "VAR",
        "@alpha @beta Alpha Beta Chi Delta Epsilon Eta Gamma Iota Kappa Lambda Mu Nu Omega Omicron Phi Pi Psi "
        "Re Rho Sigma Tau Theta Upsilon VarLambda VarOmega Xi Zeta aleph alpha amalg beta beth chi delta ell "
        "epsilon eta eth gamma imath iota jmath kappa lambda mho mu nu omega omicron phi psi rho sigma tau "
        "theta top upsilon varDelta varGamma varPhi varPi varPsi varSigma varTheta varUpsilon varXi "
        "varepsilon varkappa varphi varpi varpropto varrho varsigma vartheta wr xi zeta backepsilon"
    ),
    ("PARTIAL", "L", "VAR", "partial nabla"),
    ("PI", "L", "VAR", "pi"),
    ("INFTY", "L", "VAR", "infty @infty"),
    ("EMPTY", "L", "VAR", "empty emptyset varnothing"),
    (
        "ANGLE",
        "L",
        "VAR",
        "triangledown triangle angle vartriangleleft vartriangleright vartriangle triangleleft triangleright "
        "measuredangle sphericalangle"
    ),
    ("PERP", "L", "VAR", "perp bot"),
    ("CIRC", "L", "VAR", "circ"),
    ("PERCENT", "L", "VAR", "@percent"),
    ("DOTS", "L", "VAR", "@dots dots ldots vdots cdots ddots ddot dddot ddddot dotsb dotsc dotsi dotsm dotso iddots"),
    (
        "VERT",
        "L",
        "VAR",
        "@vert @Vert vert Vert Arrowvert arrowvert bracevert rvert=vert lvert=vert rVert=Vert lVert=Vert mid "
        "nmid"
    ),
    ("EXISTS", "N", "SEP_CLASS", "exists nexists"),
    ("FORALL", "N", "SEP_CLASS", "forall"),
    ("SEP", "N", "SEP_CLASS", "cr newline @newline enspace atop @comma @semicolon @colon And @And qquad quad"),
    (
        "ARROW",
        "C",
        "SEP_CLASS",
        "to searrow uparrow updownarrow upharpoonleft upharpoonright upuparrows Leftarrow Leftrightarrow "
        "Lleftarrow Longleftarrow Longleftrightarrow Longrightarrow Lsh Rightarrow Rrightarrow Rsh Uparrow "
        "Updownarrow circlearrowleft circlearrowright curvearrowleft curvearrowright Downarrow downarrow "
        "downdownarrows downharpoonleft downharpoonright hookleftarrow hookrightarrow gets iff impliedby "
        "implies leftarrow leftarrowtail leftharpoondown leftharpoonup leftleftarrows leftrightarrow "
        "leftrightarrows leftrightharpoons leftrightsquigarrow longleftarrow longleftrightarrow longmapsto "
        "longrightarrow looparrowleft looparrowright mapsto multimap nLeftarrow nLeftrightarrow nRightarrow "
        "nearrow nleftarrow nleftrightarrow nrightarrow nwarrow rightarrow rightarrowtail rightharpoondown "
        "rightharpoonup rightleftarrows rightleftharpoons rightrightarrows rightsquigarrow swarrow leadsto"
    ),
    ("EXP", "L", "FUN_CLASS", "exp"),
    ("LOG", "L", "FUN_CLASS", "lg ln log"),
    ("TRIGONOMETRIC", "L", "FUN_CLASS", "sin sinh arcsin cos arccos cosh tan tanh arctan cot coth csc sec"),
    ("SIGN", "L", "FUN_CLASS", "sgn signum sign"),
    ("MAXMIN", "L", "FUN_CLASS", "max min"),
    ("NAME_FUN", "L", "FUN_CLASS", "Pr deg det dim gcd hom ker"),
    ("USR_FUN", "L", "FUN_CLASS", "@usr_fun"),
    ("ARG", "L", "SUM_CLASS", "arg"),
    ("INFSUP", "L", "SUM_CLASS", "inf sup liminf limsup varliminf varlimsup"),
    ("BCAPCUP", "L", "SUM_CLASS", "bigcap bigcup bigsqcup biguplus bigvee bigwedge"),
    ("BIGO", "L", "SUM_CLASS", "bigcirc bigodot bigoplus bigotimes bigtriangledown bigtriangleup"),
    ("SUM", "L", "SUM_CLASS", "sum"),
    ("PROD", "L", "SUM_CLASS", "prod coprod"),
    ("LIM", "L", "SUM_CLASS", "lim injlim varinjlim varprojlim projlim"),
    ("INT", "L", "SUM_CLASS", "idotsint int iint iiint iiiint intop smallint oint"),
    (
        "GTLS",
        "C",
        "REL_CLASS",
        "@equal doteq=equal Doteq=equal approxeq backsimeq circeq cong backsim curlyeqprec curlyeqsucc "
        "eqslantgtr eqslantless equiv gnsim triangleq eqsim thicksim sim simeq nsim neq notequiv=neq frown "
        "between eqcirc smallfrown smallsmile approx asymp ge geq geqq geqslant gg gnapprox gt @gt gtrapprox "
        "gtrdot gtreqless gtreqqless gtrless gtrsim le leq leqq leqslant lessapprox lessdot lesssim ll "
        "lnapprox lneq lneqq lt @lt lvertneqq ncong ne ngeq ngeqq ngeqslant nleq nleqq nleqslant nless nprec "
        "npreceq nsucc nsucceq prec preceq succ succapprox succcurlyeq thickapprox trianglelefteq "
        "trianglerighteq succeq succnapprox succneqq succnsim succsim unlhd unrhd gneq gneqq gvertneqq ggg "
        "gggtr ngtr precapprox preccurlyeq precnapprox precneqq precnsim precsim"
    ),
    ("CAPCUP", "C", "REL_CLASS", "Cap cap Cup cup curlyvee dashv curlywedge land lor sqcap sqcup vee veebar wedge"),
    ("BOWTIE", "C", "REL_CLASS", "Join bowtie"),
    (
        "SUBSET",
        "C",
        "REL_CLASS",
        "Subset Supset nsubseteq nsupseteq subset sqsubset sqsubseteq sqsupset sqsupseteq subseteq subseteqq "
        "subsetneq subsetneqq supset supseteq supseteqq supsetneq supsetneqq varsubsetneq varsubsetneqq "
        "varsupsetneq varsupsetneqq"
    ),
    ("INNI", "C", "REL_CLASS", "in ni notin=ni owns"),
    ("PARALL", "C", "REL_CLASS", "nparallel parallel"),
    ("PROPTO", "C", "REL_CLASS", "propto"),
    ("ARROW", "C", "X_ARROW", "xleftarrow xrightarrow"),
)

#: Symbols without a spelling of their own come first, in this order.
FIRST = "nil bignum zero one float hanger base bracket array angle slash hair arrow ceil floor verts".split()


def _numbered() -> dict[str, int]:
    """Symbol numbers: FIRST, then the symbols of ROWS from the last to the first one met."""
    met = [n.split("=")[-1].lstrip("@") for *_, names in ROWS for n in names.split()]
    new = [s for s in dict.fromkeys(met) if s not in FIRST]
    return {s: i for i, s in enumerate([*FIRST, *reversed(new)])}


SYMBOLS = _numbered()
#: Letters follow the symbols, numbers follow the letters, up to 16 bits.
LETTERS = len(SYMBOLS)
NUMBERS = LETTERS + 52
VOLUME = 65535
#: command -> (terminal, class, kind, symbol number)
COMMANDS = {n.split("=")[0]: (terminal, cls, kind, SYMBOLS[n.split("=")[-1]]) for cls, kind, terminal, names in ROWS for n in names.split() if n[0] != "@"}


def number_symbol(n: int) -> int:
    return SYMBOLS["bignum"] if n >= VOLUME - NUMBERS else NUMBERS + n


def letter_symbol(c: str) -> int:
    return LETTERS + (ord(c) - 97 if c >= "a" else 26 + ord(c) - 65)
