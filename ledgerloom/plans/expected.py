"""Fixed values that the SQL of the checks needs, spelled out apart from the library it checks."""

# White space, number patterns and constants of programs.
SPACE_CHARS = '\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000'

FLOAT_LITERAL = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\z"

PLAIN_NUMBER = r"^[ \t\n\r\x0b\f]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[ \t\n\r\x0b\f]*\z"

CANDIDATE_PATTERNS = [
    "(?:^|[" + SPACE_CHARS + r"])(\([-+]?\d+(?:,\d{3})*(?:\.\d+)?\))",
    r"\$?([-+]?\d{1,3}(?:,\d{3})*\.\d+)%?",
    r"\$?([-+]?\d*\.\d+)",
    r"\$?([-+]?\d{1,3}(?:,\d{3})*)%?",
    r"([-+]?\d+)",
]

CONSTANTS = {'const_100': 100,
 'const_1000': 1000,
 'const_10000': 10000,
 'const_100000': 100000,
 'const_1000000': 1000000,
 'const_m1': -1,
 'const_0': 0,
 'const_1': 1,
 'const_2': 2,
 'const_3': 3,
 'const_4': 4,
 'const_5': 5,
 'const_10': 10,
 'const_12': 12,
 'const_31': 31,
 'const_365': 365}

# Published execution accuracies (model, method, percent).
PUBLISHED = [('GPT-3', 'answer-only-prompt', 24.09), ('GPT-3', 'CoT prompting', 40.63), ('GPT-3', 'DSL program', 45.15),
 ('FinQANet(RoBERTa-large)', 'DSL program', 68.9), ('Human Expert', '', 89.44)]

# Word lists and the sentences of the selection check.
TIME_WORDS = ['year', 'fy', 'fiscal', 'period', 'month']

FINANCIAL_TERMS = ['revenue', 'sales', 'income', 'profit', 'loss', 'expenses', 'costs', 'assets', 'liabilities', 'equity',
 'debt', 'cash', 'margin']

INTENT_WORDS = [('analyze_change', ['change', 'increase', 'decrease', 'difference']),
 ('calculate', ['calculate', 'compute', 'total']), ('compare', ['compare', 'versus', 'vs'])]

QUERY_TYPES = {'lookup': 'selection',
 'calculate': 'calculation',
 'compare': 'comparison',
 'aggregate': 'aggregation',
 'analyze_change': 'change_analysis'}

METRIC_TERMS = ['revenue', 'sales', 'income', 'profit', 'loss', 'expenses', 'costs']

TIME_MARKS = ['year', 'quarter', 'q1', 'q2', 'q3', 'q4']

WARN_SENIOR = "🚨 Question asks for 'senior notes' but selected data doesn't mention 'senior'"

WARN_GENERAL = '⚠️  Using general/aggregate debt costs - consider if specific instrument costs are needed'

HINT_SENIOR = "Look for table rows specifically labeled with 'senior notes' or similar"

HINT_FOLLOW_UP = '💡 This seems to be a follow-up question - use the same data from previous calculation'

REVIEW = 'Review data selection before calculating'

PROCEED = 'Proceed with calculation'
