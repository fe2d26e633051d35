"""Taggers for the noun filters. Any callable of the same form may take their place.

An English tagger maps a list of tokens to Penn tags; a Chinese tagger maps a text to (word, tag) pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

EnglishTagger = Callable[[list[str]], list[str]]
ChineseTagger = Callable[[str], list[tuple[str, str]]]

_CLOSED = {
    "DT": "a an the this that these those each every some any no all both half either neither such another",
    "IN": "of in on at by for with about against between into through during before after above below from up down out over under as than if because while until since although though whether",
    "PRP": "i you he she it we they me him her us them myself yourself himself herself itself ourselves themselves who whom whose which what",
    "PRP$": "my your his its our their", "CC": "and or but nor so yet", "MD": "can could may might must shall should will would",
    "VB": "am is are was were be been being have has had do does did go goes went gone get got make made take took come came see saw seen know knew think say said give gave find found tell told become became",
    "RB": "not never always often very too also just still again here there then now once ever almost", "TO": "to", "UH": "oh yes",
    "JJ": "old new good bad great small large big little long short high low early late young own other many few more most last first next different same able free full sure clear recent",
}
_TAG = {w: t for t, ws in _CLOSED.items() for w in ws.split()}
_ENDS = (
    ("ly", "RB"), ("ing", "VBG"), ("ed", "VBN"), ("ous", "JJ"), ("ful", "JJ"), ("less", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("ive", "JJ"), ("ical", "JJ"), ("ional", "JJ"), ("ary", "JJ"), ("ish", "JJ"), ("ize", "VB"), ("ise", "VB"),
    ("iest", "JJS"),
)
_NOUNS = set("thing king ring spring string wing evening morning building meeting seed bed need speed library secretary dictionary boundary salary summary diary anniversary fish dish family reply bee".split())


_ENDINGS = tuple(e for e, _ in _ENDS)


@lru_cache(maxsize=1 << 16)
def _tag_word(token: str, first: bool) -> str:
    low = token.lower()
    if not (token.isalpha() or any(c.isalpha() for c in token)):
        return "CD" if any(c.isdigit() for c in token) else "."
    if low in _TAG:
        return _TAG[low]
    if token[:1].isupper() and not first:
        return "NNP"
    if low in _NOUNS:
        return "NN"
    if low.endswith(_ENDINGS) and (tag := next((t for e, t in _ENDS if low.endswith(e) and len(low) > len(e) + 2), None)):
        return tag
    return "NNS" if low.endswith("s") and not low.endswith(("ss", "us", "is")) and len(low) > 3 else "NN"


class WordTagger:
    """Closed classes, endings, capitals; anything else is a noun. A tag depends on the word and on whether it is the first, so `word` tells it, and tokens that repeat need not be told anew."""

    word = staticmethod(_tag_word)

    def __call__(self, tokens: list[str]) -> list[str]:
        return [self.word(token, not i) for i, token in enumerate(tokens)]


tag_english = WordTagger()


class DictionaryTagger:
    """Chinese words by the longest match in a dictionary {word: tag}; characters outside it are words tagged "x"."""

    def __init__(self, words: dict[str, str]):
        self.words, self.longest = dict(words), max(map(len, words), default=1)

    def __call__(self, text: str) -> list[tuple[str, str]]:
        out, i = [], 0
        while i < len(text):
            n = next((n for n in range(min(self.longest, len(text) - i), 0, -1) if text[i : i + n] in self.words), 0)
            word = text[i : i + (n or 1)]
            out.append((word, self.words.get(word, "x")))
            i += len(word)
        return out


_CHINESE = {
    "p": "据 受 至 自 从 在 于 对 对于 关于 由 由于 为 为了 以 与 同 向 往 朝 按 按照 根据 依据 随着 通过 经 经过 把 被 让 给 比 用 因 因为 除 除了 到 跟 沿 沿着 趁 距 较",
    "c": "和 及 以及 或 或者 并 并且 而 而且 但 但是 不过 然而 所以 因此 如果 虽然 尽管 即使 不仅 还是 且 则 于是 从而",
    "u": "的 地 得 了 着 过 等 等等 等地 之 所 们 似的",
    "d": "将 不 没 没有 也 都 就 才 又 再 还 更 最 很 非常 十分 已 已经 正在 曾 曾经 仍 仍然 只 仅 均 共 约 大约 可能 必须 应 应该 便 即 即将 尤其 特别 一直 总是 经常 往往 逐渐 相当 比较 越来越 分别 同时 目前",
    "v": "是 有 说 称 表示 认为 指出 介绍 报道 宣布 进行 开始 继续 成为 达到 出现 发生 使 使得 令 来 去 可以 能 能够 会 要 想 需要 希望 看 看到 知道 觉得 发现 获得 得到 提供 包括 属于 进入 举行 参加 要求 造成 引起 导致 位于 来自 超过 增加 减少 提高 降低 上升 下降 建设 发展起来 预计 显示 住 吃 喝 走 做 买 卖 爱 喜欢",
    "vn": "影响 发展 合作 研究 调查 工作 生活 活动 服务 投资 管理 教育 训练 比赛",
    "r": "我 你 您 他 她 它 我们 你们 他们 她们 它们 自己 这 那 这个 那个 这些 那些 这里 那里 此 该 各 每 某 什么 谁 哪 哪里 怎么 如何 多少 其 其中 其他 本 大家",
    "f": "上 下 中 内 外 前 后 里 间 东 西 南 北 东部 西部 南部 北部 中部 东北部 西北部 东南部 西南部 以上 以下 以内 以外 之间 之后 之前 之中 附近 左右 前后",
    "t": "今天 明天 昨天 今年 明年 去年 上午 下午 早上 晚上 夜间 白天 凌晨 中午 傍晚 现在 当时 近日 日前 今后 此前 此后 春天 夏天 秋天 冬天 周一 周二 周三 周四 周五 周六 周日",
    "m": "一 二 三 四 五 六 七 八 九 十 百 千 万 亿 两 几 多 半 第一 第二 第三 许多 一些 大量 不少 全部 所有",
    "q": "个 日 月 年 时 分 秒 次 位 名 件 条 张 只 种 项 家 座 场 度 元 米 公里 公斤 吨 岁 天 号 点",
    "a": "大 小 好 坏 新 旧 高 低 长 短 多云 快 慢 美丽 漂亮 重要 主要 著名 严重 明显 不同 一般 冷 热 红 白 黑 蓝 绿",
    "n": "消息 地区 部分地区 新闻 记者 公司 有限公司 大学 大学生 中学 小学 中心 中国 中央 上海 下午茶 和平 将军 地方 地球 地图 地铁 日本 月亮 年轻人 时间 时代 分子 天气 天空 冷空气 弱冷空气 内蒙古 西安 西藏 东北地区 东京 南京 北京 南方 北方 东方 西方 经济 经验 对象 对手 自然 自由 自行车 从业者 为人 同学 同志 向导 以色列 与会者 因素 法国 好人 新疆 高山 长江 长城 大家庭 小说 小时 点心 家庭 家长 场所 名字 位置 条件 张家口 种类 项目 号码 元素 米饭 所长 了解 得分 着火点 过程 等级 之道 本人 本科 该校 中文 外语 前线 后果 里程 间谍 会议 会员 要素 能源 能力 是非 有机物 说法 来源 去向 看法 一带一路 三峡 四川 五四 六合 七夕 八卦 九江 十堰 百货 千岛湖 万里 亿元 两会 多样性 半岛 几何 红军 白菜 黑龙江 蓝天 绿茶 热带 冷水 不锈钢 也门 都市 就业 才能 再生 更年期 最高法院 还款",
}


class ClosedClassTagger(DictionaryTagger):
    """Chinese words by the longest match in a list of function words, frequent verbs, and nouns that begin like these; a run of other letters between them is one noun."""

    def __init__(self, more: dict[str, str] | None = None):
        super().__init__({w: tag for tag, ws in _CHINESE.items() for w in ws.split()} | (more or {}))

    def __call__(self, text: str) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for word, tag in super().__call__(text):
            if tag == "q" and not (out and (out[-1][1] in "mr" or out[-1][0][-1].isdigit())):
                tag = "x"  # a measure stands after a number or a pronoun; elsewhere it is a part of a noun
            kind = tag if tag != "x" else "n?" if "\u3400" <= word <= "\u9fff" or word > "\U00020000" else "x"
            if kind == "n?" and out and out[-1][1] == "n?":
                out[-1] = out[-1][0] + word, kind
            else:
                out.append((word, kind))
        return [(w, "n" if t == "n?" else t) for w, t in out]


tag_chinese = ClosedClassTagger()


def noun_runs(words: Iterable[tuple[str, str]], drop_last: bool = False) -> list[str]:
    """Consecutive words whose tag contains "n", each run joined.

    drop_last: the last word never joins a run; it counts alone, and only if the word before it isn't a noun.
    """
    seq = list(words)
    out, run = [], ""
    for k, (word, tag) in enumerate(seq):
        if drop_last and k == len(seq) - 1:
            if run:
                out.append(run)
            elif "n" in tag:
                out.append(word)
            return out
        if "n" in tag:
            run += word
        elif run:
            out.append(run)
            run = ""
    return out + [run] * bool(run)
