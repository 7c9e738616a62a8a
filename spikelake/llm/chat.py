"""Chat formatting with typed content parts, with DataFrame operations alone.

A turn holds an array of parts: text, image, audio and document. A visitor, one expression for each kind, flattens them in
their order: a text is written with its control strings escaped; an attachment becomes a placeholder, and its reference,
place and number of tokens after expansion are recorded. A conversation is a sequence of pieces

    <|turn|> role <|body|> parts <|end|>

Escape: a control string gets a backslash after its first character; where backslashes stand there already it gets one
more, so that taking one away gives back each text exactly. Besides this template's marks, which all begin with <|, the
marks of other public templates are escaped, so no tokenizer takes a text's for its own.

Turns stand by turn (null first), then role, then parts; rows that agree in all are turns of their own. Null
roles and texts count as empty, null parts and null arrays of parts give nothing, parts of another kind become <|file|>
with no tokens. Rows with a null id form one conversation. An empty table gives an empty table. Only the named columns are
read, so others can't clash. Places are running sums in windows, and nothing is appended in loops, so very long texts and
conversations take time in proportion; a conversation is one value, of up to 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Marks of public chat templates after their first character, as regular expressions.
AFTER_ANGLE, AFTER_SQUARE = r"\||/?s>|/?SYS>>|start_of_turn>|end_of_turn>", r"/?INST\]"
#: What an attachment expands to: patches of an image, frames of audio, tokens of a page.
PATCH, FRAMES, PAGE = 14, 50.0, 512
PLACEHOLDER = r"<\|(image|audio|document|file)\|>"
PIECE = ("text", "kind", "uri", "tokens", "loss")


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, rf"<(\\*)({AFTER_ANGLE})", r"<\\$1$2")
    return F.regexp_replace(text, rf"\[(\\*)({AFTER_SQUARE})", r"[\\$1$2")


def unescaped(text: Column) -> Column:
    text = F.regexp_replace(text, rf"<\\(\\*)({AFTER_ANGLE})", "<$1$2")
    return F.regexp_replace(text, rf"\[\\(\\*)({AFTER_SQUARE})", "[$1$2")


class Visitor:
    """A piece for each kind of part. Subclass it to count tokens in another way."""

    def __init__(self, loss: Column):
        self.loss = loss

    def piece(self, text: Column, kind: Column | None = None, uri: Column | None = None, tokens: Column | None = None, loss: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            text.alias("text"),
            (none.cast("string") if kind is None else kind).alias("kind"),
            (none.cast("string") if uri is None else uri).alias("uri"),
            F.coalesce(none if tokens is None else tokens, F.lit(0)).cast("long").alias("tokens"),
            (F.lit(False) if loss is None else loss).alias("loss"),
        )

    def text(self, part: Column) -> Column:
        return self.piece(escaped(F.coalesce(part["text"], F.lit(""))), loss=self.loss)

    def _attachment(self, kind: str, part: Column, tokens: Column | None = None) -> Column:
        return self.piece(F.lit(f"<|{kind}|>"), F.lit(kind), part["uri"], tokens)

    def image(self, part: Column) -> Column:
        return self._attachment("image", part, F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH))

    def audio(self, part: Column) -> Column:
        return self._attachment("audio", part, F.ceil(part["seconds"] * FRAMES))

    def document(self, part: Column) -> Column:
        return self._attachment("document", part, part["pages"] * PAGE)

    def other(self, part: Column) -> Column:
        return self._attachment("file", part)

    def visit(self, part: Column) -> Column:
        kind = part["type"]
        found = F.when(kind == "text", self.text(part))
        for name in ("image", "audio", "document"):
            found = found.when(kind == name, getattr(self, name)(part))
        return found.otherwise(self.other(part))


def text_part(text: Column) -> Column:
    """An array with one part, the text."""
    fields = [f.split(":") for f in PART[7:-1].split(",")]
    given = {"type": F.lit("text"), "text": text}
    return F.array(F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields]))


def formatted(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learned: tuple[str, ...] = ("assistant",), visitor: type[Visitor] = Visitor
) -> DataFrame:
    """conv_id; segments, in order: text and loss, whether it is learned; loss_spans: start and end, in code points of the
    whole; attachments: kind, uri, place (code points) and tokens; n_tokens, of all attachments. `text` joins segments.

    parts is an array of PART. The text of a turn is learned if its role is one of `learned`, its marks and placeholders never.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.col(parts).cast(f"array<{PART}>").alias("parts"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "parts")))
    flat = visitor(F.col("role").isin(*learned))
    body = F.transform(F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()), flat.visit)
    head = flat.piece(F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY)))
    pieces = rows.select("conv_id", "r", F.posexplode(F.concat(F.array(head), body, F.array(flat.piece(F.lit(END))))).alias("pos", "p"))
    chars = F.char_length("p.text").cast("long")
    before = Window.partitionBy("conv_id").orderBy("r", "pos").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum(chars).over(before), F.lit(0)))
    found = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("r", "pos", "start", "p"))).alias("all"))
    return found.select(
        "conv_id",
        F.transform("all", lambda x: F.struct(x.p.text.alias("text"), x.p.loss.alias("loss"))).alias("segments"),
        F.transform(F.filter("all", lambda x: x.p.loss), lambda x: F.struct(x.start.alias("start"), (x.start + F.char_length(x.p.text)).alias("end"))).alias("loss_spans"),
        F.transform(F.filter("all", lambda x: x.p.kind.isNotNull()), lambda x: F.struct(x.p.kind.alias("kind"), x.p.uri.alias("uri"), x.start.alias("place"), x.p.tokens.alias("tokens"))).alias("attachments"),
        F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + x.p.tokens).alias("n_tokens"),
    )


def text(segments: Column) -> Column:
    """The whole text of a conversation."""
    return F.array_join(F.transform(segments, lambda s: s.text), "")


def learned_text(segments: Column) -> Column:
    """The text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescaped(s.text)), "")


def read_back(whole: Column) -> Column:
    """The turns of a formatted text: role, texts (those between attachments), kinds (of the attachments)."""
    marked = F.filter(F.split(whole, r"<\|turn\|>", -1), lambda t: t != "")
    body = lambda t: F.replace(F.substring_index(t, BODY, -1), F.lit(END), F.lit(""))
    return F.transform(
        marked,
        lambda t: F.struct(
            unescaped(F.substring_index(t, BODY, 1)).alias("role"),
            F.transform(F.split(body(t), PLACEHOLDER, -1), unescaped).alias("texts"),
            F.regexp_extract_all(body(t), F.lit(PLACEHOLDER), F.lit(1)).alias("kinds"),
        ),
    )
