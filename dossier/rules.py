"""Fixed values of the policy rules: term lists, thresholds and labels.

These are data. The operators take them as arguments, so another pack can be
passed in their place.
"""

SECTIONS = ("一类违规行为", "二类违规行为", "三类违规行为")

# Glossary: standard term, aliases, expansions, type, conditions (name -> terms).
GLOSSARY = (
    ("年休假", ("年假", "年休假", "带薪年假", "带薪年休假", "休假管理办法"), ("年休假", "年假", "带薪年假", "带薪年休假", "休假管理办法"), "benefit_rule", ()),
    ("旷工", ("旷工", "连续旷工", "擅自不出勤", "擅自离岗", "缺勤"), ("旷工", "连续旷工", "擅自不出勤", "擅自离岗", "缺勤"), "behavior", ()),
    ("语言不得体", ("骂人", "说脏话", "脏话", "辱骂", "言语攻击", "语言不得体", "怠慢"),
     ("语言不得体", "骂人", "说脏话", "脏话", "辱骂", "言语攻击", "怠慢", "投诉"), "behavior",
     (("对象为客户或来访者", ("客户", "来访者")), ("并引起投诉", ("投诉", "被投诉", "引起投诉")))),
    ("师德师风失范", ("没有师德", "师德", "师德师风", "违反师德", "教师职业行为准则"), ("师德师风失范", "师德", "师德师风", "违反师德", "教师职业行为准则"), "behavior", ()),
    ("打听工资", ("打听工资", "讨论工资", "工资", "奖金", "津贴补贴", "个人待遇"),
     ("打听工资", "打听、讨论员工工资", "工资", "奖金", "津贴补贴", "个人待遇信息", "二类违规行为", "违反保密义务行为"), "behavior", ()),
    ("虚假报销", ("虚假报销", "报销未发生", "虚假理由报销"), ("虚假报销", "报销未发生的费用", "虚假理由报销", "弄虚作假行为", "二类违规行为"), "behavior", ()),
    ("二类违规行为", ("二类违规", "二类违规行为"), ("二类违规行为", "二类违规"), "policy_section", ()),
    ("一类违规行为", ("一类违规", "一类违规行为"), ("一类违规行为", "一类违规"), "policy_section", ()),
    ("三类违规行为", ("三类违规", "三类违规行为"), ("三类违规行为", "三类违规"), "policy_section", ()),
)

# Question aspects of the intent reader, first match wins. Terms of one entry are alternatives.
INTENT_ACTION = ("处罚", "处分", "处理", "处理方式", "怎么处理", "如何处理", "纪律处分", "违规处理", "惩罚", "后果", "会怎样", "有什么事", "怎么办", "警告", "记过", "辞退")
INTENT_DEFINITION = ("是什么", "什么是", "定义", "指什么", "什么意思")
INTENT_PROCESS = ("流程", "步骤", "怎么申请", "如何申请", "审批", "办理")
INTENT_EXCEPTION = ("例外", "除外", "特殊情况", "豁免")
INTENT_TABLE = ("几天", "多少天", "几次", "多少次", "额度", "标准", "对照")
INTENT_LISTING = ("有哪些", "包括哪些", "包含哪些", "哪几类", "哪几种", "几类", "类型有哪些", "类别有哪些")
CLASS_WORDS = ("违规", "行为", "类别", "类型")
LEAVE_WORDS = ("年假", "年休假", "带薪年假", "带薪年休假")

# Question aspects of the rule resolver, first match wins.
RESOLVER_ACTION = (
    "处罚", "处分", "处理", "处理方式", "怎么处理", "如何处理", "纪律处分", "违规处理", "惩罚", "后果", "警告", "记过", "降级", "辞退", "解除劳动合同",
    "绩效", "薪酬影响", "会怎样", "怎么办",
)
RESOLVER_ASPECTS = (
    ("disciplinary_action", RESOLVER_ACTION),
    ("section_listing", ("有哪些", "包括哪些", "包含哪些", "哪几类", "哪几种", "类别有哪些", "类型有哪些")),
    ("definition", ("是什么", "属于什么", "哪类", "什么违规", "定义")),
    ("process", ("流程", "怎么申请", "如何申请")),
    ("applicability", ("能不能", "是否", "可以吗", "适用")),
    ("exception", ("例外", "特殊情况", "除外")),
)
ACTION_RETRIEVAL = (
    "处罚", "处分", "处理", "违规处理", "处分流程", "处理方式", "纪律处分", "警告", "记过", "降级", "辞退", "解除劳动合同", "绩效考核", "薪酬影响", "最终处理决定", "申诉",
)

ASPECT_EVIDENCE = (
    ("disciplinary_action", ("action_evidence", "classification_evidence")), ("definition", ("definition_evidence",)), ("process", ("process_evidence",)),
    ("classification", ("classification_evidence",)), ("section_listing", ("listing_evidence",)), ("table_lookup", ("table_evidence",)), ("exception", ("exception_evidence",)),
)

EMPLOYEE_OBJECTS = ("旷工", "语言不得体", "师德师风失范", "年休假")
EMPLOYEE_WORDS = ("员工", "老师", "教师", "我")

# Absence rules.
ABSENCE_TERMS = ("旷工", "连续旷工", "擅自不出勤", "擅自离岗", "未提前提交请假申请", "请假申请未经学校批准", "逾期不归", "逾期不出勤", "缺勤", "未出勤")
ABSENCE_TITLES = ("工作时间及假期管理制度", "***公司人守则-工作时间及假期管理制度", "员工纪律制度", "***公司人守则-员工纪律制度")
UNDER_THREE_TERMS = ("连续旷工3个工作日以下", "旷工少于三天", "二类违规行为", "破坏学校管理秩序行为", "员工纪律制度", "***公司人守则-员工纪律制度", "扣除旷工期间工资", "记过处分")
THREE_OR_MORE_TERMS = ("连续旷工3个工作日及以上", "一年内累计两次及以上旷工", "一类违规行为", "员工纪律制度", "***公司人守则-员工纪律制度", "扣除旷工期间工资", "辞退处分")
CONDUCT_TITLES = ("员工纪律制度", "***公司人守则-员工纪律制度")
RULES = (
    {"rule_id": "absence_under_3_workdays", "fact": "duration", "operator": "<", "threshold": 3, "condition": "连续旷工3个工作日以下",
     "key": "continuous_absence_under_3_workdays", "actions": ("扣除旷工期间工资", "记过处分"), "search": UNDER_THREE_TERMS,
     "classes": ("二类违规行为", "破坏学校管理秩序行为", "5.2旷工少于三天")},
    {"rule_id": "absence_3_or_more_workdays", "fact": "duration", "operator": ">=", "threshold": 3, "condition": "连续旷工3个工作日及以上",
     "key": "continuous_absence_3_or_more_workdays", "actions": ("扣除旷工期间工资", "辞退处分"), "search": THREE_OR_MORE_TERMS,
     "classes": ("一类违规行为", "连续旷工3个工作日及以上")},
    {"rule_id": "absence_twice_or_more_in_one_year", "fact": "occurrence", "operator": ">=", "threshold": 2, "condition": "一年内累计两次及以上旷工",
     "key": "absence_twice_or_more_in_one_year", "actions": ("扣除旷工期间工资", "辞退处分"), "search": THREE_OR_MORE_TERMS,
     "classes": ("一类违规行为", "一年内累计两次及以上旷工")},
)

# Behaviors in order: the first with a trigger in the question wins.
BEHAVIORS = (
    {"behavior": "absenteeism", "label": "旷工", "triggers": ABSENCE_TERMS, "section": None, "clause": None, "subclause": None,
     "classes": ("旷工", "旷工少于三天", "二类违规行为", "破坏学校管理秩序行为"),
     "search": ("旷工", "连续旷工3个工作日以下", "连续旷工3个工作日及以上", "一年内累计两次及以上旷工", "扣除旷工期间工资", "记过处分", "辞退处分", "旷工少于三天"),
     "titles": ABSENCE_TITLES, "not_sections": (), "not_clauses": (), "conditions": ()},
    {"behavior": "abusive_language", "label": "语言不得体", "triggers": ("骂人", "说脏话", "脏话", "辱骂", "言语攻击", "语言不得体"),
     "section": "三类违规行为", "clause": "4. 侵犯学校权益行为", "subclause": "4.2",
     "classes": ("三类违规行为", "侵犯学校权益行为", "4.2对客户、来访者怠慢或语言不得体"),
     "search": ("语言不得体", "怠慢", "投诉", "三类违规行为", "侵犯学校权益行为", "书面或口头警告"),
     "titles": CONDUCT_TITLES, "not_sections": ("一类违规行为", "二类违规行为"), "not_clauses": (),
     "conditions": (("对象为客户或来访者", ("客户", "来访者")), ("并引起投诉", ("投诉", "被投诉", "引起投诉")))},
    {"behavior": "teacher_ethics", "label": "师德师风失范", "triggers": ("没有师德", "师德", "师德师风", "违反师德", "教师职业行为准则"),
     "section": "二类违规行为", "clause": "1. 师德师风相关的违规行为", "subclause": "1.1",
     "classes": ("二类违规行为", "师德师风相关的违规行为", "1.1违反教师职业行为准则"),
     "search": ("师德师风", "教师职业行为准则", "限制性规定", "二类违规行为", "记过处分"),
     "titles": CONDUCT_TITLES, "not_sections": ("一类违规行为", "三类违规行为"), "not_clauses": (), "conditions": ()},
    {"behavior": "salary_inquiry", "label": "打听工资", "triggers": ("打听工资", "讨论工资", "工资", "奖金", "津贴补贴", "个人待遇"),
     "section": "二类违规行为", "clause": "2. 违反保密义务行为", "subclause": "2.3",
     "classes": ("二类违规行为", "违反保密义务行为", "2.3打听、讨论员工工资"),
     "search": ("打听、讨论员工工资", "奖金", "津贴补贴", "个人待遇信息", "二类违规行为", "违反保密义务行为"),
     "titles": CONDUCT_TITLES, "not_sections": ("一类违规行为", "三类违规行为"), "not_clauses": (), "conditions": ()},
    {"behavior": "false_reimbursement", "label": "虚假报销", "triggers": ("虚假报销", "报销未发生", "虚假理由报销"),
     "section": "二类违规行为", "clause": "4. 弄虚作假行为", "subclause": "4.3",
     "classes": ("二类违规行为", "弄虚作假行为", "4.3虚假报销"),
     "search": ("虚假报销", "报销未发生的费用", "虚假理由报销", "4.3", "弄虚作假行为"),
     "titles": CONDUCT_TITLES, "not_sections": ("一类违规行为", "三类违规行为"), "not_clauses": ("3. 侵犯学校权益行为", "5. 破坏学校管理秩序行为"), "conditions": ()},
    {"behavior": "lateness", "label": "迟到", "triggers": ("迟到", "早退", "停课", "顶课", "调课"),
     "section": "三类违规行为", "clause": "5. 破坏学校管理秩序行为", "subclause": "5.1",
     "classes": ("三类违规行为", "破坏学校管理秩序行为", "5.1一学年中出现两次及两次以上", "一学年中出现两次及两次以上"),
     "search": ("迟到", "早退", "一学年中出现两次及两次以上", "三类违规行为", "破坏学校管理秩序行为"),
     "titles": CONDUCT_TITLES, "not_sections": ("一类违规行为", "二类违规行为"), "not_clauses": (), "conditions": ()},
)

# Clauses that can be asked for by name: section, number, title, terms.
CLAUSES = (
    ("二类违规行为", "1", "师德师风相关的违规行为", ("师德师风相关的违规行为", "师德师风", "教师职业行为准则")),
    ("二类违规行为", "2", "违反保密义务行为", ("违反保密义务行为", "保密义务")),
    ("二类违规行为", "3", "侵犯学校权益行为", ("侵犯学校权益行为", "学校权益")),
    ("二类违规行为", "4", "弄虚作假行为", ("弄虚作假行为", "弄虚作假")),
    ("二类违规行为", "5", "破坏学校管理秩序行为", ("破坏学校管理秩序行为", "破坏学校管理秩序")),
    ("一类违规行为", "5", "破坏学校管理秩序行为", ("破坏学校管理秩序行为", "破坏学校管理秩序")),
    ("三类违规行为", "5", "破坏学校管理秩序行为", ("破坏学校管理秩序行为", "破坏学校管理秩序")),
)

# Guardrails and hints.
SENSITIVE_TERMS = ("工资", "身份证", "手机号", "账号", "密码")
DOMAIN_TERMS = ("制度", "规则", "年假", "年休假", "报销", "考勤", "安全", "政策", "处罚", "处分", "旷工", "骂人", "说脏话", "师德")
CONDUCT_WORDS = ("违规", "弄虚作假", "旷工", "骂人", "说脏话", "脏话", "辱骂", "语言不得体", "师德", "师德师风")
CATEGORY_HINTS = (
    ("leave", ("年假", "年休假")), ("conduct", CONDUCT_WORDS), ("attendance", ("考勤", "迟到", "早退", "离岗")), ("hr", ("薪酬", "员工", "HR")),
    ("finance", ("报销", "采购", "发票", "财务")), ("security", ("安全", "账号", "数据", "外传")),
)
AUDIENCE_EMPLOYEE = ("员工", "老师", "教师", "HR", "违规", "弄虚作假", "旷工", "迟到", "早退", "离岗", "骂人", "说脏话", "脏话", "辱骂", "语言不得体", "师德", "师德师风")
AUDIENCE_STUDENT = ("学生", "幼儿园", "小学", "初中", "高中")
INTENT_HINTS = (("process_lookup", ("流程", "怎么申请", "如何申请")), ("eligibility_check", ("能不能", "是否", "可以吗")), ("policy_comparison", ("区别", "对比", "比较")))
TIME_HINTS = ("今年", "最新", "现在", "2026")
RELATIVE_TIME = ("今年", "最新", "现在")
EXTRACTED_TERMS = ("员工", "年假", "年休假", "报销", "考勤", "安全", "违规", "二类违规", "弄虚作假", "虚假报销", "处罚", "处分", "处理", "旷工", "迟到", "早退", "离岗")
QUESTION_MARKERS = ("吗", "么", "什么", "怎么", "如何", "是否", "处罚", "处分", "处理", "会怎样", "怎么办")
BARE_ASSERTIONS = ("我没有违规", "没有违规", "我未违规", "未违规", "我没有违反制度", "没有违反制度")
FOLLOW_UP_BLOCKERS = ("旷工", "违规", "处罚", "处分", "处理", "报销", "采购", "账号", "数据", "安全")
SIX_OR_MORE = ("第六年及以后", "六年及以后", "6年及以后")
LEAVE_EXPANSIONS = ("带薪年休假", "休假管理办法")
# A turn that inherits the leave topic, and a self-judgement.
ANNUAL_LEAVE = "年休假"
INHERITED_EXPANSIONS = ("年休假", "年假", "带薪年假", "带薪年休假", "休假管理办法")
INHERITED_REASON = "上一轮问题已经落在年休假，本轮只补充工龄参数，因此继承年休假语境。"
INHERITED_NOTE = "通过 conversation_context 将追问补全为年休假工龄规则查询。"
ASSERTION_CONDITIONS = ("具体行为", "发生时间", "对象/影响范围")
ASSERTION_NOTE = "需要用户描述事实，系统才能匹配制度条款。"
#: Intent of an exact lookup by its answer aspect.
ASPECT_INTENTS = (
    ("disciplinary_action", "policy_disciplinary_action_lookup"), ("section_listing", "policy_section_listing_lookup"), ("clause_detail", "policy_clause_detail_lookup"),
)

# Evidence.
ACTION_TERMS = ("处罚", "处分", "处理", "警告", "记过", "辞退", "扣除", "解除劳动合同", "调薪", "年终奖")
STRONG_ACTION_TERMS = ("予以", "给予", "警告", "记过", "辞退", "扣除", "解除劳动合同", "调薪", "年终奖")
CLASSIFICATION_TERMS = (
    "一类违规行为", "二类违规行为", "三类违规行为", "属于", "师德师风相关的违规行为", "违反保密义务行为", "侵犯学校权益行为", "弄虚作假行为", "破坏学校管理秩序行为",
)
LISTING_EXCLUDE = ("违规行为相应处理", "处理结果", "处罚依据")
DEFINITION_SIGNALS = ("指", "定义", "是指", "是")
REFERENCE_TERMS = ("参见", "详见", "参考", "参照", "见《", "具体参见")
PROCESS_TERMS = ("流程", "步骤", "申请", "审批", "办理", "提交")
TABLE_TERMS = ("第一年", "第二年", "第三年", "第四年", "第五年", "第六年", "天数", "如下", "标准")
CLASS_SIGNALS = ("一类违规行为", "二类违规行为", "三类违规行为", "破坏学校管理秩序行为")
TOPIC_TERMS = (
    ("leave", ("年假", "年休假", "带薪年休假", "休假管理办法")), ("attendance", ("考勤", "迟到", "早退", "旷工", "离岗")), ("finance", ("报销", "采购", "发票", "财务", "票据")),
    ("security", ("安全", "账号", "数据", "外传", "凭证")), ("conduct", ("违规", "处分", "处罚", "旷工", "弄虚作假", "虚假报销", "纪律")),
)
STUDENT_SCOPE = ("学生", "幼儿园", "小学", "初中", "高中", "学段", "家长")
SHARED_MARKERS = (
    ("一类违规行为", ("一类及二类违规", "一类违规行为")), ("二类违规行为", ("二类、三类违规", "一类及二类违规", "二类及三类违规")),
    ("三类违规行为", ("二类、三类违规", "二类及三类违规", "三类违规行为")),
)
ACTION_SCOPE = (
    ("一类违规行为", ("1.1一类违规行为", "1.1 一类违规行为", "一类违规行为："), ("1.2二类违规行为", "1.2 二类违规行为", "1.2二类违规")),
    ("二类违规行为", ("1.2二类违规行为", "1.2 二类违规行为", "二类违规行为："), ("1.3三类违规行为", "1.3 三类违规行为", "1.3三类违规", "1.4 ", "2. 其他处分规定", "2.其他处分规定")),
    ("三类违规行为", ("1.3三类违规行为", "1.3 三类违规行为", "三类违规行为："), ("1.4 ", "2. 其他处分规定", "2.其他处分规定")),
)
ACTION_SCOPE_SIGNALS = ("违规行为相应处理", "处分", "处理", "调薪", "年终奖", "解除劳动合同", "警告")
CONDITION_SIGNALS = ("一学年", "两次", "少于", "及以上", "并引起", "投诉", "造成")
YEAR_LABELS = ("第一年", "第二年", "第三年", "第四年", "第五年", "第六年及以后")
FEEDBACK_TYPES = ("correct", "wrong_source", "missing_clause", "irrelevant_answer", "too_verbose", "scope_leak", "unsafe_or_sensitive")
