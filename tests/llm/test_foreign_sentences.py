"""Recall by kind on sentences that share nothing with the training sentences nor with the test tables."""

from __future__ import annotations

from collections import Counter

from marlgate.llm import pii, spans

SENTENCES = """
Please forward it to [name:John Smith] and [name:Sarah O'Connor] by noon.
[name:Thomas Müller] wohnt in Berlin, [name:Stefan Weber] in Köln.
Kind regards, [name:Jennifer Walsh]
I met with [name:Daniel Kim] and [name:Maria Gonzalez] yesterday.
Dear [name:Peter Jackson], the offer stands.
请联系[name:王建国]，他负责此事。[name:李娜]女士已确认。
Mail [email:bob@startup.dev] or [email:maria@company.co.jp] today. Contact: [email:support-team@my-firm.technology]
Her number is [phone:+91 98765 43210], his is [phone:+81 3-1234-5678]. Telefon [phone:089 1234567], Fax [phone:030 9876543]
Call me on [phone:555-0199] please. My mobile: [phone:+34 612 345 678]
Visit us at [address:45 Oak Tree Parkway], Springfield. The office moved to [address:221 Baker Street], London.
家住北京市朝阳区[address:建国路88号]，三楼。 Wir sitzen in der [address:Hauptstraße 5], Berlin. Livraison au [address:24 avenue des Champs-Élysées], Paris.
For the form: SSN [id_number:123-45-6789]. Passport [id_number:CD1234567]. 身份证号码 [id_number:110105199003072316] 。
Mr. [name:Ahmed Hassan] will call from [phone:+971 50 123 4567]. Ask [name:Emma Thompson] or [name:Lukas Becker].
From: [name:Yuki Tanaka] <[email:yuki.tanaka@example.co.jp]> Cordialement, [name:Julien Moreau]
The invoice was approved by [name:Patricia Nguyen] last Friday, and [name:George Adams] will countersign.
Bitte rufen Sie [name:Klaus Hoffmann] unter [phone:+43 1 5123456] an oder schreiben Sie an [email:k.hoffmann@kanzlei-wien.at].
Merci de prévenir [name:Nicolas Petit], [address:8 rue Victor Hugo], ou écrire à [email:npetit@mairie.paris].
昨天已与[name:刘志强]确认，新地址：[address:人民南路56号]，电话 [phone:010-62345678] 。
Our agent [name:Olivia Bennett] moved to [address:908 Cedar Grove Lane]. Phone [phone:(415) 555-0132].
Passeport n° [id_number:FR7654321] et SSN [id_number:321-54-9876] vus.
Thanks, [name:Brian Murphy]
Return it to [address:77 Massachusetts Avenue], Cambridge, or leave it at [address:12 rue Lafayette], Lyon.
Unsere Werkstatt ist in der [address:Bergstraße 14a], das Lager [address:Am Stadtpark 3]. 仓库在[address:解放大道12号]。
"""
QUIET = """
New York and Los Angeles are closed on Monday. The Federal Reserve met. Morgan Stanley cut its target for Deutsche Bank.
Order 20230415778 was filled at 12.50, ticket 2022-1134-5567, version 10.4.2.11, batch 2023011234.
Die Deutsche Bundesbank tagt am Montag 12 Uhr. Le Conseil se réunit en mars. 会议将于三月举行，项目应用的方法和时间待定。
Quarterly Report for Risk Management, see Appendix B. Met at noon. Then we left.
"""


def test_recall_and_precision_by_kind():
    lexicon, model = pii.training_lexicon(), pii.trained_field()
    hit, total, made = Counter(), Counter(), Counter()
    for text, truth in pii.labelled(SENTENCES):
        got = {(x.start, x.end, x.kind) for x in model.decode(spans.candidates(text, lexicon))}
        hit.update(k for *_, k in got & truth)
        total.update(k for *_, k in truth)
        made.update(k for *_, k in got)
    print({k: (hit[k], total[k], made[k]) for k in spans.KINDS})
    for kind in spans.KINDS:
        assert hit[kind] / total[kind] >= 0.9 and hit[kind] / made[kind] >= 0.9, (kind, hit[kind], total[kind], made[kind])


def test_nothing_is_found_where_nothing_is():
    lexicon, model = pii.training_lexicon(), pii.trained_field()
    assert [text[x.start : x.end] for text, _ in pii.labelled(QUIET) for x in model.decode(spans.candidates(text, lexicon))] == []
