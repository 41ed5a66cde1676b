"""The chains that make TeX and Markdown plain, on texts whose results were worked out by hand."""

from pyspark.sql import functions as F

from folio.functions.text import plain_markdown
from folio.operators.structure import tex_text

TEX = [
    ("a % note\n  % whole line\nb 50\\% \\%% c", "a \n\nb 50% %"),
    ("\\section{One}\nx\\subsection*{Two}y\\subsubsection{Three}", "## One\n\nx\n\n#### Two\ny\n\n#### Three"),
    ("\\paragraph{P} z \\caption{C d}", "**P**： z \n图注：C d"),
    ("\\begin{abstract}A b\\end{abstract}c", "## 摘要\nA b\nc"),
    ("\\begin{equation*}\nx\n\\end{equation*}\\[y\\]\\(z\\)", "$\nx\n$\n\n$y$\n $z$"),
    ("\\begin{align}a\\end{equation}", "a"),
    ("\\begin{itemize}\\item one\\item[k] two\\end{itemize}", "- one\n- [k] two"),
    ("\\includegraphics[w=1]{f.png} \\href{u}{t} \\url{v}", "（图：f.png） t（u） v"),
    ("\\textbf{B} \\emph{i} see~\\cite[p.~1]{k}, \\ref{r}. \\footnote{f}\\vspace*{1em}", "B i see~, ."),
    ("a\t b\n\n\n\nc", "a b\n\nc"),
    (None, ""),
]
MARKDOWN = [
    ("# A\r\n ## B\r#### C\n##### D", "A\nB\nC\n##### D"),
    ("> q\n  >r\n- i\n * s\n1. o\n 12) t\n1.x", "q\nr\n• i\n• s\no\nt\n1.x"),
    ("**b\nc** `d` $$e\nf$$ $g$ $h\ni$", "b\nc d e\nf g $h\ni$"),
    ("  \n x \n ", "x"),
    (None, ""),
]


def test_tex(spark):
    cases = TEX
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "id long, t string")
    assert [r.x for r in rows.select("id", tex_text(F.col("t")).alias("x")).orderBy("id").collect()] == [w for _, w in cases]


def test_markdown(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(MARKDOWN)], "id long, t string")
    assert [r.x for r in rows.select("id", plain_markdown(F.col("t")).alias("x")).orderBy("id").collect()] == [w for _, w in MARKDOWN]
