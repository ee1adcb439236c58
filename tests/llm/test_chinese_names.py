"""Chinese names of four characters and of rarer families."""

from __future__ import annotations

import pytest

from marlgate.llm import pii


@pytest.mark.parametrize(("text", "name"), [("已与欧阳文博确认。", "欧阳文博"), ("此致 上官雨欣 数据组", "上官雨欣"), ("下周由翁文博接手。", "翁文博"), ("下周由李涵接手。", "李涵"), ("东方证券 已上调。", None), ("司库 高度", None)])
def test_names_are_found_whole(text, name):
    assert pii.findings(text, pii.training_lexicon(), pii.trained_field()) == ([("name", name)] if name else [])
