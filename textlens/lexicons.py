"""Word lists by profile and list name, in their natural order."""

ZH_LISTS: dict[str, list[str]] = {
    "banned_marks": ["；", "！！！", "？！"],
    "templates_check": ["眼中闪过", "嘴角勾起", "眼眶微红", "不可置信", "眼底闪过", "咬了咬唇", "身子一颤", "心头一紧", "倒吸一口凉气", "目光一凝", "瞳孔一缩"],
    "templates_audit": ["眼中闪过", "嘴角勾起", "眼眶微红", "不可置信", "眼底闪过", "咬了咬唇"],
    "templates_context": ["眼中闪过", "嘴角勾起", "眼眶微红", "不可置信", "眼底闪过", "咬了咬唇", "冷冷地说"],
    "thinking": ["心想", "意识到", "感到", "觉得", "认为", "明白"],
    "patterns_audit": ["对X而言", "一切都在", "一种说不出的", "的意义在于"],
    "patterns_context": ["对X而言", "一切都在", "她心想", "她意识到", "她感到", "一种说不出的", "真正的X是Y", "X的意义在于", "X既是Y也是Z", "谁说X就一定Y"],
    "open_endings": ["未完待续", "未完", "......", "…", "故事还在继续", "新的开始"],
    "ending_power": ["终于", "成功", "幸福", "圆满", "胜利", "归来", "结束", "结局"],
    "stop": ["一个", "没有", "自己", "什么", "他们", "我们", "不是", "这个", "那个", "已经", "知道", "可以", "起来", "现在", "还是", "如果", "因为", "所以", "但是", "然而", "不过", "只是", "就是", "都", "会", "很"],
    "boilerplate": ["试读", "版权所有"],
}

ZH_GENRES: dict[str, dict[str, list[str]]] = {
    "default": {
        "climax": ["打脸", "反转", "碾压", "震惊", "崩溃", "愤怒", "嚣张", "冷笑"],
        "emotion": ["碾压", "打脸", "反转", "震惊全场", "不可思议", "难以置信", "冷笑", "不屑", "嘲讽", "威胁", "警告", "霸气", "强势", "泪流满面", "欣喜若狂", "激动万分", "终于", "成功", "胜利"],
        "setup": ["系统", "金手指", "重生", "穿越", "绑定", "觉醒", "激活"],
    },
    "系统流": {
        "climax": ["系统", "面板", "模拟", "绑定", "激活", "碾压", "反转", "震惊全场", "突破", "进化"],
        "emotion": ["面板", "点数", "模拟", "突破", "绑定", "激活", "进化", "升级", "碾压", "反转", "震惊", "打脸", "终于", "成功", "羡慕", "嫉妒", "不敢置信", "不可思议"],
        "setup": ["系统", "绑定", "面板", "激活", "模拟", "新手", "任务", "宿主"],
    },
    "虐恋": {
        "climax": ["误会", "心碎", "眼泪", "离开", "回头", "追妻", "后悔", "跪下"],
        "emotion": ["心碎", "眼泪", "误会", "离开", "转身", "后悔", "跪下", "深情", "虐心", "疼痛", "窒息", "崩溃", "绝望", "重逢", "原谅"],
        "setup": ["结婚", "契约", "替身", "误会", "离婚", "相遇", "重逢"],
    },
    "重生": {
        "climax": ["重生", "前世", "报仇", "复仇", "逆转", "碾压", "打脸", "后悔"],
        "emotion": ["重生", "前世", "报仇", "复仇", "碾压", "打脸", "逆转", "后悔", "震惊", "终于", "成功", "胜利", "归来"],
        "setup": ["重生", "前世", "死亡", "回到", "醒来", "复活"],
    },
}

# Surnames by how sure they are, and what can't be in or must follow a name.
COMPOUND_SURNAMES = ["慕容", "欧阳", "司马", "上官", "诸葛", "东方", "西门", "南宫", "独孤", "端木", "尉迟", "皇甫", "令狐", "夏侯", "长孙", "宇文", "司徒", "司空"]
STRONG_SURNAMES = "赵钱孙李周吴郑王冯蒋韩杨朱秦尤何吕施张孔曹严华金魏陶姜戚谢邹喻章"
MEDIUM_SURNAMES = "苏沈顾楚陆萧"
WEAK_SURNAMES = "方白江林叶云柳陈许"
UNLIKELY_SECOND = "的得地了着过上中下内外前后左右里旁边这个些次回和与及或但而把被给对向从由吗呢吧啊什么每各某一二三四五六七八九十百千万亿零东西南北不"
NAME_CONTEXT = "，。！？：'\"说问道喊叫嚷骂答哭笑叹看走向站坐来去便就吃喝走跑拿放打推抱点望轻微悄缓也已只都还才又再正总"
NUMERALS = "一二三四五六七八九十百千万亿零"
SPEECH_TAIL = "说问道喊叫嚷骂答哭笑叹怒斥喝看"
NAME_WHITELIST = ["白云"]

# Stages in order with the template file and section of each.
STAGES = [
    ("脑洞", "prompt_inspiration.md", "脑洞生成器"),
    ("灵感风暴", "prompt_inspiration.md", "灵感风暴"),
    ("人设", "prompt_character.md", "人设生成器"),
    ("大纲", "prompt_outline.md", "大纲相关"),
    ("细纲", "prompt_outline.md", "细纲生成"),
    ("概要", "prompt_outline.md", "概要生成器"),
    ("开篇", "prompt_opening.md", "黄金开篇"),
    ("正文", "prompt_writing.md", "写作要求"),
    ("优化", "prompt_polish.md", "优化建议"),
    ("润色", "prompt_polish.md", "润色"),
    ("续写", "prompt_expand.md", "续写"),
    ("扩写", "prompt_expand.md", "扩写"),
]

# The texts of a context, in the order in which they stand in it.
ZH_CONTEXT: dict[str, str] = {
    "opening": "你是短篇小说作者。请按以下步骤写一篇约10000字的通俗短篇小说。\n",
    "sources": "## 第一步: 阅读5份指纹\n",
    "source": "### 源文{i}: {name}",
    "counts": "字数: {chars} | 句数: {sentences}",
    "ratios": "!/句: {exclamations} | ,/句: {commas}",
    "terms": "高频人名: {terms}",
    "lines": "\n开篇30行:\n{opening}",
    "dimensions": """## 第二步: 从5篇中提取公约数

按以下维度对比5篇，提取公约数(≥3篇共有) AND 剔除作者指纹(1-2篇独有)：

| 维度 | 文1 | 文2 | 文3 | 文4 | 文5 | 公约数 |
|---|---|---|---|---|---|---|
| 死亡方式 | ? | ? | ? | ? | ? | 从5篇中最少出现的那种里面挑一个全新的 |
| 重生触发 | ? | ? | ? | ? | ? | 公约数保留 |
| 背景设定 | ? | ? | ? | ? | ? | 挑一个5篇都不用的全新设定 |
| 背叛者 | ? | ? | ? | ? | ? | 公约数保留 |
| 复仇手段 | ? | ? | ? | ? | ? | 从5篇都不用的方法中自创 |
| 独特道具 | ? | ? | ? | ? | ? | 剔除，自创全新 |
""",
    "constraints": """## 第三步: 用公约数生成

死亡方式和背景必须是你自创的，不能跟任何一篇源文相同或相似。
如果犹豫一个设定是否太像某篇源文 → 换掉。宁可远，不可近。
目标: 成稿中不出现任何一篇源文里的16字连续原文。
""",
    "rules": """
## 生成硬性约束

### 标点禁令
- 永远禁止: ； ！！！ ？！ 「」
- 不用引号，对话用 名字：或裸嵌入

### 禁用句式(一个都不能出现):
{patterns}

### 禁用模板描写(一个都不能出现):
{templates}

### 风格规则
- 第一人称
- 数字分节: 1 2 3...(裸数字，无标题)
- 分隔符: ……
- 精确数字: 金额/时间/数量精确到个位
- 压缩情感循环: 每弧≤8句
- 巧合推动情节: ≥1次意外发现
- 短段快节奏: 一段=一个动作/一句对话/一个念头
- 每段同时存在≤5字句和≥40字句
- 句式突变: 相邻3句不同结构
- 番茄小白话: 小学六年级词汇为主,复句≤30%
- 零思维标记: 禁用 心想/意识到/感到/觉得/认为
- 多主语修复: 无 他他他/她她她 连续序列
- 语域碰撞: 100字内正式+粗俗并置≥1次
- 刻意词汇重复: 500字内关键词≥3次
- 人设标签(≥3): 杀伐果断/清醒独立/拒绝内耗/黑莲花/人间清醒/搞钱脑
- 禁用: 圣母/优柔寡断/憋屈/精神内耗
""",
    "output": "\n## 输出\n直接输出故事正文。不要前言、后记、说明。\n",
}

# What a stage asks for in an interactive run.
STAGE_QUESTIONS: dict[str, list[tuple[str, str]]] = {
    "脑洞": [("小说类型", "例如：古代/现代/科幻"), ("核心卖点", "例如：一句话写出最吸引人的一点"), ("目标受众", "例如：少年/成人")],
    "人设": [("主角人设", "例如：冷静/勇敢/固执"), ("金手指类型", "例如：记忆/技能/工具")],
    "开篇": [("开篇风格", "例如：对话/场景/悬念")],
    "正文": [("开篇风格", "例如：对话/场景/悬念")],
}

# Our own lists for Latin-script corpora.
LATIN_LISTS: dict[str, list[str]] = {
    "banned_marks": [";", "!!", "?!"],
    "templates_check": ["ther", "tion the", "that", "ment", "lich", "ción"],
    "templates_audit": ["ther the", "in the", "de la"],
    "templates_context": ["ther the", "in the", "de la"],
    "thinking": ["ingen", "ereon", "ouen"],
    "patterns_audit": ["of the", "que la", "und"],
    "patterns_context": ["of the", "que la", "und"],
    "open_endings": ["...", "tbc", "re ", "un"],
    "ending_power": ["end", "fin", "est", "aus"],
    "stop": ["the", "and", "of", "to", "in", "is", "la", "le", "de", "und", "der", "el", "que"],
    "boilerplate": ["Licensed under", "Copyright"],
}
LATIN_GENRES = {
    "default": {"climax": ["er", "st"], "emotion": ["ing", "tion", "ment", "ung", "ado"], "setup": ["Th", "La", "De"]},
    "plain": {"climax": ["on"], "emotion": ["an", "en"], "setup": ["A"]},
}
LATIN_CONTEXT = {
    "opening": "Write a short story in the manner that these sources share.\n",
    "sources": "## Sources\n",
    "source": "### {i}: {name}",
    "counts": "letters: {chars} | sentences: {sentences}",
    "ratios": "exclamations a sentence: {exclamations} | commas a sentence: {commas}",
    "terms": "frequent terms: {terms}",
    "lines": "\nopening:\n{opening}",
    "dimensions": "## Shared traits\n\n| trait | shared |\n|---|---|\n| setting | ? |\n| conflict | ? |\n",
    "constraints": "## Constraints\n\nNo passage of 16 characters of any source.\n",
    "rules": "\n## Rules\n\nNone of these patterns: {patterns}\nNone of these phrases: {templates}\n",
    "output": "\n## Output\nThe story only.\n",
}
