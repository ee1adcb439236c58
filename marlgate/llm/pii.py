"""Personal information inside free text: find it, and replace it by typed placeholders.

A semi-Markov conditional random field chooses among candidate segments (``spans``). Its weights are trained here, from the
hand-labelled sentences below, once in every worker (a fraction of a second, always the same result). Candidates are open:
any domain after an @, runs of 7 to 15 digits, runs of capitalised words or Han characters; known endings, national
groupings, a lexicon of known parts of names with the beginnings and endings these share, common given names and how a
public vocabulary spells a word are features that learnt weights judge.

Defined results. A null or empty text has no findings and stays as it is. Headers and quoted text count; message ids, host
names of relays and encoded text don't. A found text is as written, with each run of white space, ``>`` and ``|`` as one
blank; a document names each text and kind once. No finding stays in a redacted text. Whole texts are searched, however long. Repeated rows give repeated
findings only under different ids. Extra columns are left alone. A vocabulary that is missing or not whole on an executor
stops the query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgate.llm.spans import BLANKS, KINDS, MARKUP, TOUCHED, Lexicon, Segment, SemiMarkovField, candidates, cut, joined, origin, view

MOST_NAME_PARTS = 1_000_000  # the lexicon is broadcast; a larger one is refused

# Labelled sentences: [kind:text]. Names are made of the parts below; Ruvin and Stolsson are kept from the lexicon, and so
# is Korbinian, which resembles nothing in it.
TRAINING_GIVEN = [a + b for a in ("Al", "Mo", "Ru", "Ge") for b in ("dan", "vin", "lis", "ton") if a + b != "Ruvin"]
TRAINING_FAMILY = [a + b for a in ("Harg", "Stol", "Wint", "Breck") for b in ("field", "mann", "sson", "wood") if a + b != "Stolsson"]
TRAINING = """
Please meet [name:Robert Taylor] and [name:Laura O'Brien] tomorrow. [name:Andreas Schäfer] wohnt hier. New York and Hong Kong are closed. Goldman Sachs cut its target.
Regards, [name:Emily Fischer] Data Desk. Yours, [name:Kenji Watanabe] Thanks, [name:Priya Ramanathan] Best, Trading Desk. Regards, Index Operations. Regards, Data Desk. Thanks, Risk Team.
Dear [name:Michael Johnson], we spoke with [name:Olga Petrovna] and with [name:Imre Szabó]. Dear Michael, Dear Colleagues, Dear Client Services, we spoke with London Clearing and with Deutsche Börse.
Mr. [name:Tadashi Okafor] called. Frau [name:Heike Zimmermann] hat angerufen. Mme [name:Camille Laurent] a écrit. Herr [name:Ottmar Brückner] schrieb. Dr. [name:Nuria Esteban] signed.
From: [name:Paul R. Hughes] <[email:paul.hughes@startup.dev]> To: [name:Anna Maria Keller] <[email:keller@firma.co.at]> Cc: [name:Nuno Valente] <[email:nv@casa.pt]>
The meeting in San Francisco with Morgan Stanley moved. Monday Morning Report by Risk Control. Stock Connect from Hong Kong. Sales in Frankfurt and Paris rose. Abwicklung an Deutsche Bank.
Ask [name:David Cohen] about it. [name:Sophie Martin] habite ici. [name:Hans Vogel] und [name:Claire Dubois] kommen. Mark To Market values. Paul said so. Call Robert about it. Grant Road is long.
Write to [email:carla@studio.design], [email:h.tanaka@company.co.jp] or [email:info@shop.nl]. We booked 300@83.SZ and 1200@600000.SH today. Met at noon. Then we left at desk. Please go.
Call [phone:+91 98123 45678] or [phone:+81 3-5555-1234] or [phone:+39 06 5555 1234]. Tel. [phone:089 5551234], Telefon [phone:040 5551234]. Phone: [phone:555-0142]. Mobile [phone:+61 412 555 678].
Ticket 0731-5521 is open. Reference 089-5512-77123 was rejected. Order 07-1234-5678 too. Sheet 0.12.45 and row 5550142, load 5550143. Reg. 031 2222 is a code.
She lives at [address:45 Oak Tree Parkway], he at [address:1200 Sunset Highway] and they at [address:17 Old Mill Farm Lane]. Ship it to [address:10250 Wilshire Boulevard].
Please add [name:Aldan Hargmann] to the list and tell Movin.
As agreed with [name:M. Wintfield] we stop here. Regards, Rulis
[name:Rudan Stolmann] will take over from Monday.
Hargmann Partners moved its benchmark. Wintfield Capital did not.
The Hargmann Road Fund asked again. Dear Aldan, The Wintfield Fund is closed.
From: "[name:Hargmann, Aldan]" <[email:aldan.hargmann@desk.firm.example]>
From: [name:Ruvin Stolsson] <[email:ruvin_s@firm.example.com]> To: [name:Movin Wintmann], [name:Alvin Stolsson]
Hi Movin, Both legs settled. Thanks Ruvin Stolsson is out. 
Talk to [name:Ruvin Hargfield] or to [name:Aldan Stolsson] about it.
Seen by [name:Korbinian Wintsson] and [name:R. Stolsson] today.
Regards, [name:Molis Hargsson] Data Desk Tel: [phone:(212) 555-0101]
Best, [name:Korbinian Hargmann] Settlement M: [phone:+44 (0)7700 900 123] [email:k.hargmann@mail.firm.test]
[name:Wintfield Aldan] signed, so did [name:Stolmann, A.] and [name:Hargfield M.]
Regards Aldan Data Desk. Hello Rudan, Wintfield asked. Bonjour Movin, Le ticket.
Hargmann, Wintfield and Stolmann are firms. Thanks Hargmann
Index Operations Hargler said so. Senior Analyst Wintler too. Quick Breckler, late Stolsen. Data Desk Hargfield
Hallo Kollegen, Alte Kolsson bleibt. Unser Lindmann ist da. Sheet Stolwood drops.
Met [name:Geton Breckler] and [name:Molin Stolsson] and [name:René Hargwood] and [name:Anneli Stolmann] at [name:Galdan Wintmann].
Talk to Aldan Ruvin or Movin Geton. Regards, Gelis
To: [email:movin77@firm.invalid] ([name:Movin Stolfield]), Cc: [email:RULIS@FIRM.EXAMPLE]
Order AB1234567 is still open, passport check not needed. We booked 300@57.28 on ticket 2021-2875-2502.
Settlement reference 44-2272-51405 was rejected, batch 2023930455. Reg. no. 00-4471-88213, ref. 7710-5521.
My mobile is [phone:07700 900123]. My mobile is [phone:02079460155]. 手机：[phone:010-55509829]062082.SZ在 手机：[phone:10009220005]2021-06-04的 电话 [phone:＋４４ (０)７７００ ９００ １２３] 已与[name:Rudan Stolmann]确认 已与[name:MOVIN HARGWOOD]确认 Reach the desk at [phone:020 7946 0101] ext. 31.
Call me on [phone:926.555.0138] after four. Call me on [phone:+1-762-555-0179] or [phone:02079460144].
Erreichbar unter [phone:0171 3920598] oder [phone:+49 30 23125-490]. Tel. [phone:(0)30/23125 678]
Joignable au [phone:01.99.00.74.08] ou [phone:+33 (0)1 99 00 31 44] ou [phone:01 99 00 93 90]
电话 [phone:010-55509829] 。手机：[phone:10009220005] 手机：[phone:100-0651-0021] 电话 [phone:+86 100 0391 0073]
Order 366393938016971393 was filled at 12.5. 委托374848459893598544已按12成交。批次2023868072。
[name:Molis Wintmann] [phone:597.555.0148] [phone:0049 30 23125390] [phone:(010) 5550 2840]
The numbers 10009220006 and 20231234567 are load ids. See row 10000000001 of the sheet.
For the form: SSN [id_number:666-12-3456]. It is SSN# [id_number:666123456] as before. social security no. [id_number:000 12 3456].
Run 123456789 and load 987654321 failed. Batch 202312345 too. [id_number:123-45-6789] is mine.
It is NI number [id_number:QQ123456C] as before, or nat. insurance [id_number:QQ-12-34-56-C], NINO [id_number:qq 12 34 56 d].
Codes AB 12 34 56 C are rare but [id_number:AB123456C] is one.
证件号码 [id_number:990989197508211570] ，请登记。证件号码 [id_number:99905619851206328X] 和 [id_number:997803 19750415 4223] 。
Order 123456199001011234 is odd.
For the form: passport [id_number:AB1234567]. Reisepass [id_number:CD7654321] passeport n° [id_number:EF1112223] passport no. [id_number:GH3334445]
Order CD7654321 is open. Order EF1112223 was filled. L'ordre GH3334445 est passé. 委托AB1234567已成交。
Write to [email:aldan at firm.example.com] or [email:m.stol (at) desk.firm.test] or [email:rulis[at]firm[dot]example[dot]org], thanks.
Neue Adresse: [email:movin DOT hargmann AT desk DOT firm DOT example] oder [email:al_dan99＠firm.example]
Écrire à [email:alvin77 at firm.test] en cas de souci. [email:ruvin at desk.firm.test] works.
See <x1.2@mx3.relay.example> and y99.8@mx1.relay.example for ids.
I moved, now at [address:37C N. Elder Avenue], flat 3. Courier goes to [address:2-4 Elder Mill Ct]. Badge to [address:52 Saint Orla Road].
Ich wohne jetzt [address:Lindenstraße 98 b]. Lieferung an [address:Tannenstr. 120a], [address:Mühlgasse 2].
Ich wohne jetzt [address:Am Alten Hafen 9a], Lieferung an [address:Auf der Höhe 12] oder [address:Zum Kleinen Tor 7]. Am Montag 12 Stück, Am Ticket 44 hängt es.
J'habite désormais [address:199, rue des Tilles]. Livrer au [address:65 chemin de la Brèche], [address:239 bis, bd des Courlis]
邮箱 [address:江北大道7号] 新地址：[address:中山东一路18号]，我搬到[address:白云南街3号]。现在是[address:湖路9号] 数据组 [address:长安北街56号]
新地址：[address:听泉大道214号]，三楼。请寄到[address:长汀北街56号] 现居[address:云杉路12弄3号] [address:长宁路8号]
See 12 The Elder Road today. Quote 12 Elder Road Fund rose. We see 3 Please Elder Road.
From: [name:王思远] <[email:wsy@firm.example]> 下周由[name:李涵]接手。已与[name:张博文]确认。此致 [name:陈欣怡] 数据组
请联系[name:王建军]或致电李先生。由[name:张伟]的同事处理，[name:刘芳]女士在家。联系人[name:陈静]，电话 [phone:010-55509829] 。通知应用的人，询问方法和时间，同金额的项目是高于余额的。
地址：北京市海淀区[address:学院路15号]，住在上海市徐汇区[address:衡山路9号]。寄到广州市天河区[address:体育西路103号] 收。
谢谢！ [name:韩澈] 结算部 -- [name:赵雨] Tel 谢谢！ 您好，程序 版本 高于 余额 12 黄金 。金额 方法 时间 何时 任何 Subject: 093379.SZ成交量 Re: 权重 成交量 12 平均 应用 项目 高度 
"""


def labelled(lines: str) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Texts and their labelled spans from the bracket notation."""
    out = []
    for line in lines.strip().splitlines():
        text, truth, at = "", set(), 0
        for m in re.finditer(r"\[(email|phone|id_number|address|name):((?:[^\[\]]|\[(?:at|dot)\])*)\]", line):
            text += line[at : m.start()]
            truth.add((len(text), len(text) + len(m.group(2)), m.group(1)))
            text += m.group(2)
            at = m.end()
        out.append((text + line[at:], truth))
    return out


def training_lexicon() -> Lexicon:
    chinese = [(s, "family") for s in "王李韩"]
    return Lexicon.of([(n, "given") for n in TRAINING_GIVEN] + [(n, "family") for n in TRAINING_FAMILY] + chinese)


@lru_cache(maxsize=1)
def trained_field() -> SemiMarkovField:
    lexicon = training_lexicon()
    return SemiMarkovField().fit([(candidates(text, lexicon), truth) for text, truth in labelled(TRAINING)])


def spans(text: str | None, lexicon: Lexicon, model: SemiMarkovField) -> tuple[str, list[Segment]]:
    """The view of a text and the segments chosen in it."""
    if not text:
        return "", []
    flat = view(text)
    return flat, model.decode(candidates(flat, lexicon))


def findings(text: str | None, lexicon: Lexicon, model: SemiMarkovField) -> list[tuple[str, str]]:
    """Distinct (kind, text) of a document, in order of appearance."""
    flat, chosen = spans(text, lexicon, model)
    return list(dict.fromkeys((x.kind, flat[x.start : x.end]) for x in chosen))


def _whole(flat: str, s: int, e: int) -> bool:
    """Whether the text at this place isn't a part of a longer word or number; a code or day may touch a number."""
    left, right = flat[s - 1 : s], flat[e : e + 1]
    if left.isascii() and left.isalnum() and joined(flat[s]):
        return False
    return not ("0" <= right <= "9" and flat[e - 1].isdigit() and not TOUCHED.match(flat, e))


def _written(text: str, found: list[tuple[str, str]], known: Counter) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind of every place a finding is written at: over line breaks and quote marks, and over or inside markup.
    Texts written no more often than ``known`` are left out of the first pass: their places are at hand."""
    plans = [((BLANKS, " "),)]
    if MARKUP.search(text):
        plans += [((MARKUP, " "), (BLANKS, " ")), ((MARKUP, ""), (BLANKS, " "))]
    for plan in plans:
        more = found
        if len(plan) == 1:
            flat = BLANKS.sub(" ", text)
            more = [(kind, t) for kind, t in found if flat.count(t) > known[t]]
        if not more:
            continue
        flat, steps = text, []
        for pattern, by in plan:
            flat = cut(pattern, by, flat, steps)
        for kind, t in more:
            s = flat.find(t)
            while s >= 0:
                if _whole(flat, s, s + len(t)):
                    yield origin(steps, s), origin(steps, s + len(t) - 1) + 1, kind
                s = flat.find(t, s + 1)


def redacted(text: str | None, found: list[tuple[str, str]], places: Iterable[tuple[int, int, str]] = (), known: Counter | None = None) -> str | None:
    """The text with every finding replaced by ``[KIND]``: at the places it was found (start, end, kind; by text, how
    many: ``known``), and wherever else it is written. Of findings that overlap the longest names the kind; line breaks, quote
    marks and markup inside go with it."""
    if not text or not found:
        return text
    clean, at, end, longest, name = [], 0, -1, 0, ""
    for s, e, kind in sorted({*places, *_written(text, found, known or Counter())}, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if s >= end:
            if end >= 0:
                clean.append(f"[{name.upper()}]")
                at = end
            clean.append(text[at:s])
            end, longest, name = e, e - s, kind
        else:
            if e - s > longest:
                longest, name = e - s, kind
            end = max(end, e)
    return "".join((*clean, f"[{name.upper()}]", text[end:])) if clean else text


def clean_text(text: str | None, lexicon: Lexicon, model: SemiMarkovField) -> tuple[str | None, int]:
    """The redacted text and the number of distinct findings."""
    if not text:
        return text, 0
    steps: list = []
    flat = view(text, steps)
    chosen = model.decode(candidates(flat, lexicon))
    places = [(origin(steps, x.start), origin(steps, x.end - 1) + 1, x.kind) for x in chosen]
    found = [(x.kind, flat[x.start : x.end]) for x in chosen]
    distinct = list(dict.fromkeys(found))
    return redacted(text, distinct, places, Counter(t for _, t in found)), len(distinct)


def lexicon_of(known_names: DataFrame) -> Lexicon:
    rows = known_names.select("name_part", "part_kind").where("name_part is not null and part_kind is not null").distinct().limit(MOST_NAME_PARTS + 1).collect()
    if len(rows) > MOST_NAME_PARTS:
        raise ValueError(f"more than {MOST_NAME_PARTS} known parts of names")
    return Lexicon.of(sorted((r[0].strip(), r[1].strip().lower()) for r in rows))


def find_personal(documents: DataFrame, known_names: DataFrame) -> DataFrame:
    """doc_id, kind, found_text: one row per distinct text."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon_of(known_names))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, model = shared.value, trained_field()
        for batch in batches:
            ids, kinds, texts = [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for kind, found in findings(text if isinstance(text, str) else None, lexicon, model):
                    ids.append(doc_id)
                    kinds.append(kind)
                    texts.append(found)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "kind": pd.Series(kinds, dtype=object), "found_text": pd.Series(texts, dtype=object)})

    return documents.select("doc_id", "text").where("doc_id is not null and text <> ''").mapInPandas(search, "doc_id bigint, kind string, found_text string")


def redact_personal(documents: DataFrame, known_names: DataFrame) -> DataFrame:
    """doc_id, clean_text, n_replaced (distinct texts replaced)."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon_of(known_names))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, model = shared.value, trained_field()
        for batch in batches:
            texts, counts = [], []
            for text in batch["text"]:
                cleaned, n = clean_text(text if isinstance(text, str) else None, lexicon, model)
                texts.append(cleaned)
                counts.append(n)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "clean_text": pd.Series(texts, dtype=object), "n_replaced": pd.Series(counts, dtype="int32")})

    return documents.select("doc_id", "text").mapInPandas(clean, "doc_id bigint, clean_text string, n_replaced int")


def audit(documents: DataFrame, found: DataFrame) -> DataFrame:
    """documents (with text), and what must be none: findings not written in their text, of no known kind, or named twice."""
    texts = documents.where("doc_id is not null and text <> ''")
    flat = F.regexp_replace("text", r"(?U)[\s>|]+", " ")
    written = found.join(texts.select("doc_id", flat.alias("flat")), "doc_id", "left").groupBy("doc_id", "kind", "found_text").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.contains("flat", "found_text")).alias("there")
    )
    faults = written.agg(
        F.count_if(~F.coalesce("there", F.lit(False))).alias("not_in_text"), F.count_if(~F.col("kind").isin(*KINDS)).alias("of_no_kind"), F.count_if(F.col("n") > 1).alias("named_twice"),
    )
    counted = texts.agg(F.countDistinct("doc_id").alias("documents"))
    return counted.withColumn("one", F.lit(1)).join(faults.withColumn("one", F.lit(1)), "one").drop("one")
