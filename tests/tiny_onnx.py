"""Write a tiny ONNX graph by hand (the ``onnx`` package is not needed).

dense = [sum of attended ids, number of attended tokens], weights = ids * mask / 10,
or only the first output with ``sparse=False``; ``logit=True`` gives one number per row and
``hidden=True`` one vector per token (its first entry: token id plus the sum of attended ids).
"""


def varint(n):
    out = b""
    while True:
        out += bytes([(n & 127) | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def number(tag, n):
    return varint(tag << 3) + varint(n)


def chunk(tag, data):
    data = data.encode() if isinstance(data, str) else data
    return varint(tag << 3 | 2) + varint(len(data)) + data


def attribute(name, value):
    if isinstance(value, list):
        return chunk(5, chunk(1, name) + b"".join(number(8, v) for v in value) + number(20, 7))
    return chunk(5, chunk(1, name) + number(3, value) + number(20, 2))


def node(kind, inputs, outputs, **attributes):
    body = b"".join(chunk(1, i) for i in inputs) + b"".join(chunk(2, o) for o in outputs) + chunk(4, kind)
    return chunk(1, body + b"".join(attribute(k, v) for k, v in attributes.items()))


def value(tag, name, elem, dims):
    shape = b"".join(chunk(1, chunk(2, d)) for d in dims)
    return chunk(tag, chunk(1, name) + chunk(2, chunk(1, number(1, elem) + chunk(2, shape))))


def tiny_model(path, sparse=True, logit=False, hidden=False):
    nodes = [
        node("Cast", ["input_ids"], ["x"], to=1),
        node("Cast", ["attention_mask"], ["m"], to=1),
        node("Mul", ["x", "m"], ["xm"]),
        node("ReduceSum", ["xm"], ["s"], axes=[1], keepdims=1),
        node("ReduceSum", ["m"], ["n"], axes=[1], keepdims=1),
    ]
    if hidden:
        nodes += [node("Add", ["x", "s"], ["xs"]), node("Unsqueeze", ["xs"], ["hidden"], axes=[2])]
        outputs = [value(12, "hidden", 1, ["b", "l", "h"])]
    elif logit:
        nodes.append(node("Div", ["s", "n"], ["logits"]))
        outputs = [value(12, "logits", 1, ["b", "one"])]
    else:
        nodes.append(node("Concat", ["s", "n"], ["dense"], axis=1))
        outputs = [value(12, "dense", 1, ["b", "d"])]
        if sparse:
            nodes.append(node("Identity", ["xm"], ["weights"]))
            outputs.append(value(12, "weights", 1, ["b", "l"]))
    inputs = [value(11, n, 7, ["b", "l"]) for n in ("input_ids", "attention_mask")]
    graph = b"".join(nodes) + chunk(2, "tiny") + b"".join(inputs + outputs)
    model = number(1, 6) + chunk(8, chunk(1, "") + number(2, 11)) + chunk(7, graph)
    with open(path, "wb") as f:
        f.write(model)
    return str(path)


def tiny_tokenizer(path):
    """cls 0, pad 1, eos 2, unk 3, then words."""
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    words = ["<s>", "<pad>", "</s>", "<unk>", "red", "green", "blue"]
    tok = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="<unk>"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.post_processor = processors.TemplateProcessing(
        single="<s> $A </s>", pair="<s> $A </s> </s> $B </s>", special_tokens=[("<s>", 0), ("</s>", 2)]
    )
    tok.save(str(path))
    return str(path)
