"""The rule catalogue as data: languages, patterns, matchers, weights.

Patterns are written so that Java's and RE2's regular expressions agree on
them; a leading ``(?i)`` means that case is ignored.
"""

# ---- fixed values: results depend on every entry -------------------------

#: Order matters: the first language whose extension ends a path is its own.
EXTENSIONS = {
    "javascript": [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts"],
    "python": [".py", ".pyw"],
    "go": [".go"],
    "java": [".java"],
    "ruby": [".rb"],
    "rust": [".rs"],
    "php": [".php"],
}

TEST_PATHS = {
    "javascript": [r"(?i)(\.(test|spec)\.(ts|tsx|js|jsx)$)", r"(?i)(/__tests__/|/tests?/|/fixtures/)"],
    "python": [r"(?i)test_.*\.py$", r"(?i).*_test\.py$", r"(?i)/tests?/.*\.py$"],
    "go": [r"(?i).*_test\.go$"],
    "java": [r"(?i).*Test\.java$", r"(?i).*Tests\.java$", r"(?i).*TestCase\.java$", r"(?i)/src/test/java/"],
    "ruby": [r"(?i).*_test\.rb$", r"(?i).*_spec\.rb$", r"(?i)/spec/.*\.rb$", r"(?i)/test/.*\.rb$"],
    "rust": [r"(?i).*\.rs$"],
    "php": [r"(?i).*Test\.php$", r"(?i)/tests/.*\.php$"],
}

COMMENT_START = {"javascript": ["//"], "python": ["#"], "go": ["//"], "java": ["//"], "ruby": ["#"], "rust": ["//"], "php": ["//", "#"]}

SKIP = {
    "javascript": [r"\.skip\s*\(", r"\.todo\s*\(", r"\bxit\b", r"\bxtest\b", r"\bxdescribe\b"],
    "python": [r"(?i)@pytest\.mark\.skip", r"(?i)@unittest\.skip", r"\.skipTest\s*\(", r"(?i)raise\s+unittest\.SkipTest"],
    "go": [r"t\.Skip\s*\(", r"t\.Skipf\s*\(", r"t\.SkipNow\s*\(", r"(?i)t\.Log\s*\(.*skip"],
    "java": [r"(?i)@Disabled", r"(?i)@Ignore", r"(?i)assumeTrue\s*\(", r"(?i)assumeFalse\s*\("],
    "ruby": [r"(?i)\bskip\s+", r"(?i)\bpending\b", r"xit\b", r"xdescribe\b", r"xcontext\b", r"xspecify\b", r",\s*skip:\s*true"],
    "rust": [r"(?i)#\[ignore\]"],
    "php": [r"(?i)markTestSkipped\s*\(", r"(?i)markTestIncomplete\s*\(", r"(?i)@requires", r"(?i)@group\s+"],
}
FOCUS = {
    "javascript": [r"\bfit\b", r"\bfdescribe\b", r"\.only\s*\("],
    "python": [],
    "go": [],
    "java": [r"(?i)@EnabledOnOs"],
    "ruby": [r"\bfit\b", r"\bfdescribe\b", r"\bfcontext\b", r"\bfspecify\b", r",\s*focus:\s*true"],
    "rust": [],
    "php": [],
}
NEVER_TRUE = {
    "javascript": [r"if\s*\(\s*(?:false|0)\s*\)", r"(?i)if\s*\(\s*process\.env\.\w*(?:SKIP|DISABLE|BYPASS)", r"""if\s*\(\s*typeof\s+\w+\s*===?\s*['"]undefined['"]\s*\)"""],
    "python": [r"""if\s+__name__\s*!=\s*['"]__main__['"]\s*:""", r"if\s+False\s*:", r"if\s+0\s*:"],
    "go": [r"if\s+false\s*\{", r"if\s+0\s*==\s*1\s*\{", r"//\s*if"],
    "java": [r"if\s*\(\s*false\s*\)"],
    "ruby": [r"if\s+false\s*$"],
    "rust": [r"if\s+false\s*\{"],
    "php": [r"if\s*\(\s*false\s*\)"],
}
COMMENTED_OUT = {
    "javascript": [r"(?i)//\s*(?:assert|expect|should|test|it)\s*\("],
    "python": [r"(?i)#\s*(?:assert|self\.assert)\s*\("],
    "go": [r"(?i)//\s*(assert|require|Equal|NoError)\s*\("],
    "java": [r"(?i)//\s*(assert|assertEquals|assertTrue|verify)\s*\("],
    "ruby": [r"(?i)#\s*(assert|expect|should)\s*\("],
    "rust": [r"(?i)//\s*(assert|assert_eq|assert_ne|assert!)\s*\("],
    "php": [r"(?i)//\s*(assert|expect|should)\s*\(", r"(?i)#\s*(assert|expect|should)\s*\("],
}
HAS_REASON = [r"""\.skip\s*\(\s*['"`]""", r"@pytest\.mark\.skip\s*\(", r"@pytest\.mark\.skipif\s*\(", r"@unittest\.skip\("]
EMPTY_TEST = r"""\b(it|test)\s*\(\s*['"][^'"]+['"]\s*,\s*(?:async\s*)?\([^)]*\)\s*=>\s*\{\s*\}"""
TEST_OPEN = r"""\b(it|test)\s*\(\s*['"][^'"]+['"]"""
BODY_ASSERTION = r"\b(expect|assert|vi\.|jest\.|cy\.|should|assertion)\b"
ACTIVE_ASSERTION = r"\bexpect\s*\(|\bassert\s*\("

MOCKS = {  # the position of the first match decides the confidence
    "javascript": [r"(jest|vi)\.\s*(?:doMock|mock)\s*\(", r"(jest|vi)\.\s*spyOn\s*\(", r"(jest|vi)\.\s*fn\s*\("],
    "python": [r"unittest\.mock\.patch\s*\(", r"@mock\.patch\s*\(", r"@patch\s*\(", r"MagicMock\s*\("],
    "go": [r"testify/mock", r"gomock\.NewController\s*\(", r"\.On\s*\(.*\).Return\s*\("],
    "java": [r"Mockito\.mock\s*\(", r"@Mock\b", r"@InjectMocks\b", r"Mockito\.spy\s*\(", r"Mockito\.when\s*\(", r"when\s*\(.*\)\.thenReturn\s*\(", r"mockStatic\s*\("],
    "ruby": [r"allow\(.*\)\.to\s+receive", r"expect\(.*\)\.to\s+receive", r"double\s*\(", r"instance_double\s*\(", r"class_double\s*\(", r"spy\s*\(", r"stub_const"],
    "rust": [r"mockall::", r"#[automock]", r"mock\s*\("],
    "php": [r"createMock\s*\(", r"getMockBuilder\s*\(", r"Mockery::mock\s*\(", r"m::mock\s*\(", r"shouldReceive", r"willReturn\s*\("],
}
ANY_ASSERTION = r"(?i)expect\s*\(|assert|should|it\."

_CATCH = r"\bcatch\s*(?:\s*\([^)]*\))?\s*\{"
_CATCH_ARG = r"\bcatch\s*\([^)]*\)\s*\{"
CATCH_EMPTY = {
    "javascript": [_CATCH + r"[\s/]*\}", _CATCH + r"[\s]*//.*\}"],
    "python": [r"except\s*[^:]*:\s*pass", r"except\s*[^:]*:\s*$"],
    "go": [r"_\s*=\s*err", r"if\s+err\s*!=\s*nil\s*\{[\s]*return\s+nil[\s]*\}"],
    "java": [_CATCH_ARG + r"\s*\}", _CATCH_ARG + r"\s*//.*\}"],
    "ruby": [r"rescue\s*$", r"rescue\s+\w+\s*$"],
    "rust": [_CATCH + r"[\s/]*\}"],
    "php": [_CATCH_ARG + r"\s*\}", _CATCH_ARG + r"\s*//.*\}"],
    None: [_CATCH + r"[\s/]*\}"],
}
CATCH_TODO = {
    "javascript": [r"(?i)" + _CATCH + r"\s*//\s*(TODO|FIXME|HACK)"],
    "python": [r"(?i)except\s*[^:]*:\s*#\s*(TODO|FIXME|HACK)"],
    "go": [r"(?i)//\s*(TODO|FIXME|HACK).*err"],
    "java": [r"(?i)" + _CATCH_ARG + r"\s*//\s*(TODO|FIXME|HACK)"],
    "ruby": [r"(?i)rescue\s+\w*\s*#\s*(TODO|FIXME|HACK)"],
    "rust": [r"(?i)//\s*(TODO|FIXME|HACK).*unwrap"],
    "php": [r"(?i)" + _CATCH_ARG + r"\s*//\s*(TODO|FIXME|HACK)"],
    None: [r"(?i)" + _CATCH + r"\s*//\s*(TODO|FIXME|HACK)"],
}
CATCH_PRINT = {
    "javascript": [_CATCH + r"\s*console\.\w+\s*\([^)]*\)\s*;?\s*\}"],
    "python": [r"except\s*[^:]*:\s*print\s*\("],
    "go": [r"fmt\.Print(ln|f)?\s*\(.*err", r"log\.\w+\s*\(.*err"],
    "java": [_CATCH_ARG + r"\s*System\.out\.", _CATCH_ARG + r"\s*logger\."],
    "ruby": [r"rescue\s+\w*\s*puts\s*\(", r"rescue\s+\w*\s*p\s+"],
    "rust": [r"eprintln!\s*\(", r"println!\s*\("],
    "php": [_CATCH_ARG + r"\s*echo\s+", _CATCH_ARG + r"\s*var_dump\s*\("],
    None: [_CATCH + r"\s*console\.\w+\s*\([^)]*\)\s*;?\s*\}"],
}
CATCH_NULL = _CATCH + r"""\s*return\s+(?:null|undefined|false|0|''|"")\s*;?\s*\}"""
CATCH_COMMENT = _CATCH + r"\s*//.*\}"
FINALLY_EMPTY = r"finally\s*\{\s*\}"
#: each of the patterns above and below needs one of these
HANDLER_WORDS = ["catch", "except", "err", "rescue", "finally", "unwrap", "println"]
CATCH_OPEN = {"go": r"(?i)if\s+err\s*!=\s*nil", None: r"(?i)\bcatch\s*(?:\s*\([^)]*\))?\s*\{?"}
NOT_CATCH = [r"(?i)if\s+let\s+(Err|None)", r"\.(expect|unwrap)\s*\("]
BODY_COMMENT = r"^//|^/\*|^#"
BODY_PRINT = r"^console\.\w+\s*\(|^print\s*\(|^puts?\s+|^echo\s+"
UNFINISHED = r"(?i)(TODO|FIXME|HACK)"

#: the wider classes of paths (FLT-18)
INFRA_DOT_DIRS = (
    ".git .svn .hg .jj .github .circleci .gitlab .buildkite .azure .travis .vscode .idea .zed .vs .fleet .devcontainer .husky .docker .direnv .yarn .pnpm .nx "
    ".turbo .changeset .parcel-cache .nyc_output .venv .tox .pytest_cache .mypy_cache .ruff_cache .terraform .vagrant .vercel .netlify .firebase .serverless "
    ".aws-sam .expo .storybook .docusaurus .svelte-kit .astro .wrangler .bundle .phpunit.cache .php-cs-fixer.cache .gradle .mvn .settings .nuget .cargo .build "
    ".swiftpm .elixir_ls .stack-work .dart_tool"
).split()
IGNORED_PATHS = [r"/node_modules/", r"/dist/", r"/build/", r"/\.next/", r"/\.output/", r"/coverage/", r"/\.cache/", r"/(?:tmp|temp)/", r"(?i)\.env$"]
AGENT_ROOT_FILES = [
    r"(?i)^CLAUDE\.md$", r"(?i)^AGENTS\.md$", r"(?i)^\.cursorrules$", r"(?i)^\.cursorignore$", r"(?i)^\.cursorindexignore$", r"(?i)^GEMINI\.md$", r"(?i)^\.aider\.conf\.yml$",
    r"(?i)^\.aider\.ignore$", r"(?i)^\.aider\.input\.yml$", r"(?i)^\.aider\.chat\.history\.md$", r"(?i)^\.aider\.tags\.cache\.v\d+$", r"(?i)^\.windsurfrules$",
    r"(?i)^\.github/copilot-instructions\.md$", r"(?i)^\.github/instructions/.*\.instructions\.md$", r"(?i)^\.coderabbit\.yaml$", r"(?i)^\.coderabbit\.yml$", r"(?i)^\.clinerules$",
    r"(?i)^\.roomodes$", r"(?i)^\.junie/guidelines\.md$", r"(?i)^\.trae/rules\.md$", r"(?i)^\.rules$",
]
WIDE_TEST_FILE = r"(?i)(\.(test|spec)\.(ts|tsx|js|jsx|py|rb|go|rs|kt|swift)$)|(_test\.go$)|(_spec\.rb$)|(Tests?\.(cs|java)$)|(/(?:__tests__|tests?|spec|fixtures)/)"
WIDE_SOURCE_FILE = r"(?i)\.(ts|tsx|js|jsx|mjs|cjs|py|rb|go|rs|java|kt|kts|swift|cs|cpp|cc|c|h|hpp|php|ex|exs|erl|hs|scala|dart|lua|sh|zig)$"
WIDE_DOCS_FILE = r"(?i)\.(md|mdx|txt|rst|adoc|css|scss|sass|less|styl|svg|png|jpg|jpeg|gif|ico|webp|avif)$"
WIDE_CONFIG_FILE = r"(?i)\.(json|yaml|yml|toml|cfg|ini|xml|properties|gradle|plist)$"
ROOT_CONFIG_FILES = [
    r"(?i)^\.(npmrc|yarnrc|pnpmrc)$", r"(?i)^\.(nvmrc|node-version)$", r"(?i)^\.(envrc|env)$", r"(?i)^\.(gitignore|gitattributes|gitmodules|git-blame-ignore-revs|mailmap)$",
    r"(?i)^\.(editorconfig|eslintrc|prettierrc|stylelintrc)$", r"(?i)^\.(eslintignore|prettierignore)$", r"(?i)^\.(browserslistrc|caniuse-lrc)$", r"(?i)^\.(dockerignore|containerignore)$",
    r"(?i)^\.(npmignore|packagerc)$", r"(?i)^\.(watchmanconfig)$", r"(?i)^\.(parcelrc|webpackrc)$", r"(?i)^\.(lintstagedrc|commitlintrc|czrc|releaserc)$", r"(?i)^\.(npm|yarn|pnpm)-?.*",
    r"(?i)^(tsconfig|jsconfig|deno)\.json$", r"(?i)^\.(gitpod|gitpod\.yml)$",
    r"(?i)^\.(ruby-version|python-version|tool-versions|terraform-version|node-version|java-version|go-version)$", r"(?i)^\.rspec$", r"(?i)^\.rubocop\.yml$", r"(?i)^\.php-version$",
    r"(?i)^\.php_cs(\.dist)?$", r"(?i)^\.rustfmt\.toml$", r"(?i)^\.clippy\.toml$", r"(?i)^\.formatter\.exs$", r"(?i)^\.credo\.exs$", r"(?i)^\.swiftlint\.yml$", r"(?i)^\.swiftformat$",
    r"(?i)^\.golangci\.yml$", r"(?i)^\.clang-format$", r"(?i)^\.clang-tidy$",
]

#: D7b: what opens a function, and what is no body
BODY_OPENERS = {
    "python": [r"^\s*def\s+\w+\s*\("],
    "go": [r"^\s*func\s+\w+\s*\("],
    "java": [r"^\s*(?:public|private|protected)\s+\w+\s+\w+\s*\(", r"^\s*@\w+\s*$"],
    "ruby": [r"^\s*def\s+\w+"],
    "rust": [r"^\s*fn\s+\w+\s*\("],
    "php": [r"^\s*(?:public|private|protected)?\s*function\s+\w+\s*\("],
}
BRACE_LANGUAGES = ["go", "java", "rust", "php"]
TRIVIAL_VALUES = {
    "python": [r"^pass$", r"^return\s+(?:True|False|None|0|\d+)$"],
    "go": [r"^return\s+(?:nil|true|false|0)$"],
    "java": [r"^return\s+(?:true|false|null|0);$"],
    "ruby": [r"^nil$", r"^true$", r"^false$", r"^return\s+(?:true|false|nil)$"],
    "rust": [r"^\s*$", r"^true$", r"^false$", r"^Ok\(\(\)\)$"],
    "php": [r"^return\s+(?:true|false|null|0);$"],
}
NEVER_RUN = [r"^\s*if\s*\(?\s*(?:false|0)\s*\)?\s*[:{]", r"^\s*if\s+false"]

#: what defines a symbol, by which files are cut into chunks, and its name
SYMBOL_START = {
    "javascript": [r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface)\s+\w+", r"^(?:export\s+)?const\s+\w+\s*=\s*(?:async\s*)?\("],
    "python": [r"^\s*(?:async\s+)?def\s+\w+", r"^\s*class\s+\w+"],
    "go": [r"^func\s", r"^type\s+\w+"],
    "java": [r"^\s*(?:public|private|protected)\s+(?:\w+\s+)+\w+\s*\(", r"^\s*(?:public\s+)?(?:class|interface|enum)\s+\w+"],
    "ruby": [r"^\s*def\s+\w+", r"^\s*(?:class|module)\s+\w+"],
    "rust": [r"^\s*(?:pub\s+)?fn\s+\w+", r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+\w+", r"^impl\b"],
    "php": [r"^\s*(?:public|private|protected)?\s*function\s+\w+", r"^\s*class\s+\w+"],
}
SYMBOL_NAME = r"(?:function|class|interface|const|def|func|type|enum|module|fn|struct|trait|impl|void|boolean|int|String)\s+(\w+)"

#: D10: what opens a function or a test, and what the lines of either hold
_ANY_FUNCTION = [
    r"(?i)^\s*(?:function|def|fn|func|sub)\s+\w+\s*\(",
    r"(?i)^\s*(?:public|private|protected|internal)?\s*(?:async\s+)?(?:function|def|fn)?\s*\w+\s*\(",
    r"^\s*const\s+\w+\s*=\s*(?:async\s*)?\(?",
    r"^\s*(?:export\s+)?(?:default\s+)?(?:function|class)\s+\w+",
]
FUNCTION_START = {
    "python": [r"^\s*def\s+\w+\s*\(", r"^\s*class\s+\w+", r"^\s*@\w+\.\w+\s*$", *_ANY_FUNCTION],
    "go": [r"^\s*func\s+\w+\s*\(", *_ANY_FUNCTION],
    "java": [r"^\s*(?:public|private|protected)\s+\w+\s+\w+\s*\(", r"^\s*@\w+\s*$", *_ANY_FUNCTION],
    "ruby": [r"^\s*def\s+\w+", r"^\s*describe\s+", r"^\s*context\s+", *_ANY_FUNCTION],
    "rust": [r"^\s*fn\s+\w+\s*\(", r"^\s*#\[test\]", r"^\s*#\[tokio::test\]", *_ANY_FUNCTION],
    "php": [r"^\s*(?:public|private|protected)?\s*function\s+\w+\s*\(", r"^\s*@\w+\s*$", *_ANY_FUNCTION],
    None: _ANY_FUNCTION,
}
_ANY_TEST = [r"(?i)\b(it|test|describe)\s*\("]
TEST_START = {
    "python": [r"^\s*def\s+test_\w+\s*\(", r"^\s*class\s+\w+Test", *_ANY_TEST],
    "go": [r"^\s*func\s+Test\w+\s*\(", *_ANY_TEST],
    "java": [r"@Test", r"public\s+void\s+test\w+\s*\(", *_ANY_TEST],
    "ruby": [r"""^\s*(it|specify|example|scenario)\s+['"]""", r"^\s*describe\s+", r"^\s*context\s+"],
    "rust": [r"^\s*#\[test\]", r"^\s*fn\s+\w+", *_ANY_TEST],
    "php": [r"^\s*function\s+test\w+\s*\(", r"@test", *_ANY_TEST],
    None: _ANY_TEST,
}
REGISTRY_ASSERTION = {
    "javascript": [r"expect\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*\.\s*(toBe|toEqual|toMatch|toContain|toStrictEqual|toBeNull|toBeUndefined|toBeDefined|toBeTruthy|toBeFalsy)\s*\("],
    "python": [r"(?:assert|self\.assert)\s*\("],
    "go": [r"(t\.|assert\.|require\.|a\.)(Equal|NoError|Nil|NotNil|True|False|Contains|Len|Error|ErrorIs)\s*\("],
    "java": [r"(assertEquals|assertTrue|assertFalse|assertNull|assertNotNull|assertSame|assertNotSame|assertThat|verify)\s*\("],
    "ruby": [r"(expect\s*\(|assert\s*\(|should\s+|\.should\b)"],
    "rust": [r"(assert_eq!|assert_ne!|assert!)\s*\("],
    "php": [r"(assertEquals|assertSame|assertTrue|assertFalse|assertNull|assertNotNull|assertThat|expect)\s*\("],
}
LOOSE_ASSERTION = r"(?:expect|should)\s*\("
NEGATIVE = [r"toThrow", r"assertRaises", r"assertThrows", r"rejects", r"Error", r"raises", r"panic", r"(?i)fail\s*\(", r"error", r"exception"]
GENERIC = r"toBeTruthy|toBeFalsy|toBeDefined|toBeUndefined|toBeNull|assertTrue|assertFalse|assertNull|assertNotNull"
EMPTY_CATCH_LINE = r"^\s*catch\s*(?:\([^)]*\))?\s*\{\s*[/\s]*\}"
CONDITIONAL = r"\b(?:if|for|while)\s*\("
NEARBY_ASSERTION = r"expect|assert|should"

NON_FUNCTIONAL = [
    r"(?i)\.(md|txt|json|yaml|yml|toml|cfg|ini|env|gitignore|editorconfig|npmrc)$",
    r"(?i)\.(css|scss|sass|less|styl)$",
    r"(?i)\.(svg|png|jpg|jpeg|gif|ico|webp|avif)$",
    r"(?i)\.(lock|log|DS_Store)$",
    r"^\.(github|vscode|husky|testsprite)/",
    r"(?i)^LICENSE$",
    r"(?i)^CHANGELOG",
    r"(?i)^README",
    r"(?i)^CONTRIBUTING",
    r"(?i)^CODE_OF_CONDUCT",
    r"(?i)^SECURITY",
    r"(?i)^SUPPORT",
]
TELEMETRY = [r"(?i)/analytics/", r"(?i)/telemetry/", r"(?i)/tracking/", r"(?i)/metrics/", r"(?i)/monitoring/", r"(?i)/instrument(?:ation)?/"]
COMPONENT = r"(?i)\.(tsx|jsx)$"
TEST_FILE = r"(?i)(\.(test|spec)\.(ts|tsx|js|jsx)$)|(/(?:__tests__|tests?|fixtures)/)"
SOURCE_FILE = r"(?i)\.(ts|tsx|js|jsx|mjs|cjs)$"
CONFIG_FILE = r"(?i)\.(json|yaml|yml|toml|cfg|ini)$"
CLAIMS_TESTS = r"(?i)\b(test|spec|assert|expect|coverage|validation|smoke)\b"
HONEST_TITLE = r"(?i)^(build|chore|ci|fix|refactor)\s*:.*(depend|update|bump|upgrade|pin|roll|lock|unlock|migrate)"
BOTS = "renovate[bot] dependabot[bot] dependabot greenkeeper[bot] snyk-bot snyk[bot] pyup-bot scala-steward angular-robot github-actions[bot] github-actions crowdin[bot] weblate[bot] gitlocalize[bot] changesets[bot] semantic-release-bot release-drafter[bot] allcontributors[bot] deepsource-autofix[bot] pre-commit-ci[bot] pkg-pr-new[bot] imgbot[bot]".split()
COSMETIC = r"^//|^/\*|^\*|^#"

JS_ASSERTION = r"expect\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*\.\s*(toBe|toEqual|toMatch|toContain|toStrictEqual|toBeNull|toBeUndefined|toBeDefined|toBeTruthy|toBeFalsy)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*;?\s*$"
#: language -> (recognises an assertion, captures its value)
ASSERTION = {
    "python": (r"(?:assert|self\.assertEqual|self\.assertNotEqual|self\.assertTrue|self\.assertFalse|self\.assertIs|self\.assertIn|self\.assertNotIn)\s*\(", r"(?:assert|assertEqual|assertNotEqual|assertTrue|assertFalse)\s*\(?\s*([^,)]+)"),
    "go": (r"(t\.|assert\.|require\.|a\.)(Equal|NoError|Nil|NotNil|True|False|Contains|Len|Error|ErrorIs)\s*\(", r"(?:Equal|NoError|Nil|NotNil|True|False|Contains|Len)\s*\(\s*t\.\w*\s*,\s*([^,)]+)"),
    "java": (r"(assertEquals|assertTrue|assertFalse|assertNull|assertNotNull|assertSame|assertNotSame|assertThat|verify)\s*\(", r"(?:assertEquals|assertSame|assertNotSame)\s*\(\s*([^,)]+)"),
    "ruby": (r"(expect\s*\(|assert\s*\(|should\s+|\.should\b)", r"""(?:assertEquals|assertSame|expect)\s*\(?\s*['"]?([^,'")]+)"""),
    "rust": (r"(assert_eq!|assert_ne!|assert!)\s*\(", r"""(?:assertEquals|assertSame|expect)\s*\(?\s*['"]?([^,'")]+)"""),
    "php": (r"(assertEquals|assertSame|assertTrue|assertFalse|assertNull|assertNotNull|assertThat|expect)\s*\(", r"""(?:assertEquals|assertSame|expect)\s*\(?\s*['"]?([^,'")]+)"""),
}
ASSERTION_NAME = {"python": "assert", "java": "assertEquals", "ruby": "assert", "rust": "assert", "php": "assert"}

NOT_MATCHERS = "toUpperCase toLowerCase toString toExponential toFixed toPrecision toLocaleString toLocaleUpperCase toLocaleLowerCase toDateString toTimeString toISOString toJSON toSource".split()
INVENTED = (
    "toExist toNotExist toNotBe toNotEqual toNotMatch toHave toNotHave toHas toNotHas toBePresent toNotBePresent toIncludeAll toExclude toExcludeAll "
    "toBeGreaterThanZero toBeLessThanZero toBeLessThanMs toBePositiveInteger toBeNegativeInteger toBeSuccessResult toBeBooleanValue toBeTrueBoolean "
    "toBeNullOrString toBeValidEmail toBeValidUrl toBeNonEmptyString toBeNonEmptyObject toBeNonEmptyArray toBeAlphanumeric toBeNumeric toBeUppercase "
    "toBeLowercase toBeValidDate toBeFutureDate toBePastDate toBeColorHex toBeUUID toBeISODate toBePhoneNumber toBeWhitespace toBeMultiline toBeTrimmed "
    "toHaveLengthAbove toHaveLengthBelow toHaveLengthBetween toHaveKeys toHaveValues toHaveItems toContainExactly toContainOnce toContainTimes "
    "toMatchRegex toMatchPattern mustBe mustNotBe mustEqual mustNotEqual mustHave mustNotHave mustReturn mustNotReturn mustThrow mustNotThrow mustCall "
    "mustNotCall mustExist mustNotExist mustMatch mustNotMatch mustBeNull mustNotBeNull mustBeTrue mustBeFalse mustResolve mustReject hasLength "
    "hasProperty hasKey hasItem hasBeenCalled hasBeenCalledWith hasReturned haveProperty haveKey haveItem haveLength haveBeenCalled "
    "haveBeenCalledWith haveReturned willReturn willThrow willCall willResolve willReject willBe willHave"
).split()
MATCHER_LIKE = r"^(to|assert|should|must|has|have|will)"
FRAMEWORK_IMPORT = r"import\s+\{[^}]*\}\s*from\s*['\"](?:jest|vitest|@testing-library)[^'\"]*['\"]"
GLOBALS = (
    "mock mocked fn spyOn mockReturnValue mockReturnValueOnce mockResolvedValue mockResolvedValueOnce mockRejectedValue mockRejectedValueOnce "
    "mockImplementation mockImplementationOnce mockRestore mockClear mockReset anything any arrayContaining assertions extend hasAssertions not "
    "objectContaining stringContaining stringMatching describe it test expect beforeAll afterAll beforeEach afterEach vi jest should assert todo "
    "resolves rejects"
).split()
#: Only names that look like matchers are ever looked up, so others are left out.
MATCHERS = {
    "javascript": (
        "toBe toEqual toStrictEqual toBeNull toBeUndefined toBeDefined toBeTruthy toBeFalsy toBeGreaterThan toBeGreaterThanOrEqual toBeLessThan "
        "toBeLessThanOrEqual toBeCloseTo toBeNaN toBeTypeOf toBeInstanceOf toBeEmpty toBeNil toBeOneOf toBeBoolean toBeString toBeNumber toBeArray "
        "toBeObject toBeFinite toContain toContainEqual toHaveLength toHaveProperty toMatch toMatchObject toMatchSnapshot toMatchInlineSnapshot toThrow "
        "toThrowError toThrowErrorMatchingSnapshot toThrowErrorMatchingInlineSnapshot toHaveBeenCalledOnceWith toHaveBeenCalled toHaveBeenCalledOnce "
        "toHaveBeenCalledTimes toHaveBeenCalledWith toHaveReturned toHaveReturnedWith toBeArrayOfSize toBeDate toBeEmptyObject toBeEven toBeFloat "
        "toBeFunction toBeHexadecimal toBeInteger toBeNegative toBeOdd toBePositive toBeSealed toBeSerializable toBeSymbol toBeWithin toEndWith toInclude "
        "toIncludeRepeated toIncludeAllMembers toIncludeAnyMembers toIncludeEqual toStartWith toSatisfy toBeDisabled toBeEnabled toBeEmptyDOMElement "
        "toBeInTheDocument toBeInvalid toBeRequired toBeValid toBeVisible toContainElement toContainHTML toHaveAttribute toHaveClass toHaveDisplayValue "
        "toHaveErrorMessage toHaveFocus toHaveFormValues toHaveStyle toHaveTextContent toHaveValue toHaveTitle toHaveText toContainText toHaveValues "
        "toHaveCSS toHaveId toHaveJSProperty toHaveScreenshot toBeChecked toBeFocused toBeHidden toBeInViewport toBeOK toBePartiallyChecked "
        "toHaveAccessibleName toHaveAccessibleDescription toHaveRole toHaveAccessibleErrorMessage toHaveURL toHaveCount toPass"
    ).split(),
    "python": "assertEqual assertNotEqual assertTrue assertFalse assertIs assertIsNot assertIsNone assertIsNotNone assertIn assertNotIn assertIsInstance assertNotIsInstance assertRaises assertRaisesRegex assertWarns assertWarnsRegex assertAlmostEqual assertNotAlmostEqual assertGreater assertGreaterEqual assertLess assertLessEqual assertRegex assertNotRegex assertCountEqual assertMultiLineEqual assertSequenceEqual assertListEqual assertTupleEqual assertSetEqual assertDictEqual assertLogs assertNoLogs".split(),
    "go": [],
    "java": "assertEquals assertNotEquals assertTrue assertFalse assertNull assertNotNull assertSame assertNotSame assertThat assertThrows assertTimeout assertTimeoutPreemptively assertIterableEquals assertLinesMatch".split(),
    "ruby": ["to"],
    "rust": "assert_eq assert_ne assert assert_matches assert_approx_eq assert_ok assert_err assert_none assert_some".split(),
    "php": "assertEquals assertNotEquals assertSame assertNotSame assertTrue assertFalse assertNull assertNotNull assertEmpty assertNotEmpty assertCount assertContains assertNotContains assertArrayHasKey assertArrayNotHasKey assertInstanceOf assertNotInstanceOf assertGreaterThan assertGreaterThanOrEqual assertLessThan assertLessThanOrEqual assertStringContainsString assertStringNotContainsString assertMatchesRegularExpression assertDoesNotMatchRegularExpression assertFileExists assertFileNotExists assertIsReadable assertIsWritable assertJson assertJsonStringEqualsJsonString assertThat".split(),
}

AGENT_FILES = [
    r"(?i)(?:^|/)CLAUDE\.md$", r"(?i)(?:^|/)GEMINI\.md$", r"(?i)(?:^|/)AGENTS\.md$", r"(?i)(?:^|/)\.cursorrules$", r"(?i)(?:^|/)\.windsurf$",
    r"(?i)(?:^|/)\.clinerules$", r"(?i)(?:^|/)\.roomodes$", r"(?i)\.github/copilot-instructions\.md$", r"(?i)\.github/(?:AGENTS|CLAUDE|GEMINI)\.md$",
    r"(?i)(?:^|/)\.rules/(?:ai-agent|agent|claude|gemini|instructions?)\.(?:md|txt)$", r"(?i)(?:^|/)\.agents/.*\.(?:md|txt)$", r"(?i)(?:^|/)LOOP\.md$",
    r"(?i)(?:^|/)CONTEXT\.md$", r"(?i)(?:^|/)\.aider\.conf\.yml$", r"(?i)(?:^|/)\.aider\.ignore$", r"(?i)(?:^|/)\.aider\.input\.yml$", r"(?i)(?:^|/)\.coderabbit\.ya?ml$",
]
#: (label, severity, pattern), case ignored
INSTRUCTIONS = [
    ("skip_tests", "medium", r"skip\s+(flaky|failing|broken)\s+tests?"),
    ("focus_directive", "high", r"(?:use|add|prefer)\s+(xit|fdescribe|fit|xtest|xdescribe|fcontext)"),
    ("disable_test_directive", "medium", r"(?:disable|bypass|skip|remove)\s+(test|assertion|check)"),
    ("skip_test_execution", "high", r"don'?t\s+(?:run|execute|trigger)\s+tests"),
    ("pass_at_any_cost", "high", r"make\s+(?:the\s+)?tests?\s+pass\s+(?:at\s+)?all\s+costs"),
    ("fabricate_test", "high", r"fabricate\s+(?:test|coverage|assertion)"),
    ("fake_test_pass", "high", r"make\s+(?:the\s+)?tests?\s+(?:pass|green)\s+(?:without\s+)?(?:actually|making|doing)\s+(?:real|actual|proper)"),
    ("dismiss_tests", "medium", r"do\s+n['’]?t\s+(?:worry|care|bother)\s+about\s+(?:tests?|coverage|assertions?)"),
    ("dummy_tests", "medium", r"(?:generate|create|add)\s+(?:dummy|fake|placeholder|stub|trivial)\s+tests?"),
    ("minimal_test_effort", "high", r"keep\s+(?:tests?|coverage)\s+(?:happy|passing|green)\s+(?:with\s+)?minimal\s+(?:effort|changes?|work)"),
    ("conceal_ai_identity", "medium", r"never\s+(?:reveal|mention|say|tell|admit|disclose)\s+(?:you'?re|you\s+are|being)\s+(?:an\s+)?AI"),
    ("human_impersonation", "medium", r"(?:pretend|act\s+as\s+if|make\s+it\s+look)\s+(?:human|like\s+a\s+human|natural)"),
    ("disguise_directive", "medium", r"disguise|masquerade|camouflage"),
    ("conceal_ai_traces", "high", r"don'?t\s+(?:leave|add|include|show)\s+(?:AI|artificial|generated|auto.?gen)\s+(?:traces?|footprints?|marks?|labels?|tags?)"),
    ("commit_as_human", "medium", r"commit\s+(?:as|like)\s+(?:a\s+)?human"),
    ("conceal_authorship", "medium", r"don'?t\s+(?:put|add)\s+(?:AI|co-pilot|model|assistant)\s+(?:name|credit|attribution)"),
    ("strip_ai_markers", "medium", r"remove\s+(?:AI|generated|auto)\s+(?:comments?|markers?|signatures?)"),
    ("evade_detection", "high", r"(?:evade|bypass|circumvent)\s+(?:detection|review|audit|guard|check)"),
    ("avoid_detection", "high", r"avoid\s+(?:being\s+)?(?:flagged|detected|caught|identified|noticed)"),
    ("obfuscate_changes", "medium", r"(?:make|add)\s+(?:it\s+)?hard\s+(?:to\s+)?(?:detect|find|trace|notice|audit)"),
    ("minimize_changes", "low", r"(?:don'?t|never|avoid)\s+(?:change|modify|update|touch)\s+(?:too\s+)?(?:many|much)\s+(?:files|lines|modules)"),
    ("minimize_diff", "low", r"(?:keep|make)\s+(?:the\s+)?diff\s+(?:small|minimal|short|focused)"),
    ("avoid_config_changes", "low", r"don'?t\s+(?:modify|change|edit)\s+(?:package\.json|config|dependencies|lockfile)"),
    ("always_pass", "high", r"always\s+pass\s+(?:even\s+)?(?:if|when)\s+(?:tests?\s+)?fail"),
    ("suppress_errors", "high", r"(?:swallow|hide|suppress|ignore|silence)\s+(?:errors?|exceptions?|failures?|warnings?)"),
    ("suppress_errors_flex", "high", r"(?:swallow|hide|suppress|ignore|silence)\s+\w+\s+(?:errors?|exceptions?|failures?)"),
    ("bypass_testing", "high", r"(?:make\s+)?tests?\s+(?:pass|green)\s+(?:without\s+)?(?:actually|really)?\s*(?:testing|checking|validating|verifying)"),
    ("weaken_assertions", "high", r"(?:weaken|loosen|relax|simplify)\s+(?:the\s+)?(?:tests?|assertions?|expect|check)"),
    ("bypass_real_testing", "high", r"don'?t\s+actually\s+(?:test|check|verify|assert|validate)\s+(?:the\s+)?(?:logic|implementation|code|behavior)"),
    ("skip_meaningful_tests", "high", r"don'?t\s+(?:write|add)\s+(?:meaningful|real|useful)\s+(?:tests?|assertions?)"),
    ("comment_out_assertions", "high", r"(?:comment\s+out|remove|delete)\s+(?:failing|broken)?\s*(?:assertions?|expect|checks?)"),
    ("avoid_fixing", "medium", r"(?:never|don'?t|do\s+no?t)\s+(?:fix|debug|investigate)\s+(?:the\s+)?(?:implementation|code|root\s+cause|bug)"),
    ("wrap_trycatch", "medium", r"(?:wrap|surround)\s+(?:\w+\s+)*(?:in|with)\s+(?:try|catch|try/catch)"),
    ("leave_dead_code", "low", r"(?:never|don'?t)\s+(?:delete|remove|clean\s+up)\s+(?:unused|dead)\s+(?:variables?|code|imports?)"),
    ("underscore_prefix", "low", r"(?:prefix|add)\s+(?:\w+\s+)*(?:with\s+)?underscore\s+to\s+(?:unused|dead)\s+(?:variables?|params?)"),
    ("ignore_requirements", "high", r"ignore\s+(?:the\s+)?(?:actual|real|original)\s+(?:requirement|spec|behavior|intent)"),
    ("skip_context_analysis", "high", r"don'?t\s+(?:read|look\s+at|check|examine)\s+(?:the\s+)?(?:existing|original|source)\s+(?:code|tests|implementation)"),
    ("fake_pr_description", "high", r"(?:generate|write|create|draft)\s+(?:convincing|plausible|believable)\s+(?:PR|commit|description|message)"),
    ("embellish_pr", "high", r"make\s+(?:the\s+)?(?:PR|commit|description|message)\s+(?:look|sound|seem)\s+(?:good|reasonable|legitimate|innocent)"),
    ("conceal_ai_pr", "medium", r"don'?t\s+(?:mention|note|state|say)\s+(?:that|how)\s+(?:this|the)\s+(?:was|is)\s+(?:AI|generated|auto)"),
]

#: profile -> pattern type -> penalties of (high, medium, low) findings
PENALTIES = {
    "engine": {
        "disabled_assertion": (3, 2, 0),
        "assertion_tampering": (2, 1, 0),
        "mock_to_avoid_failure": (5, 2, 1),
        "claim_diff_mismatch": (0, 0, 0),
        "silent_catch_and_pass": (1, 1, 0),
        "hallucinated_assertion": (3, 2, 0),
        "ai_assisted_detection": (8, 4, 1),
        "historical_behavioral": (0, 0, 0),
        "mutation_susceptibility": (8, 3, 0),
        "agent_instruction_scan": (0, 0, 0),
    },
    "package": {},
}
DEFAULT_PENALTY = {"engine": (10, 5, 2), "package": (30, 15, 5)}
MULTIPLIERS = {"core": 1.0, "test": 1.0, "source": 1.0, "config": 0.5, "docs": 0.3, "artifact": 0.05}

# ---- end of fixed values -------------------------------------------------
#: Findings come in this order; it decides ties. What ``syntax`` and
#: ``trivial_body`` find is reported under other names.
DETECTORS = ["disabled_assertion", "assertion_tampering", "mock_to_avoid_failure", "claim_diff_mismatch", "silent_catch_and_pass", "hallucinated_assertion", "syntax", "trivial_body", "mutation_susceptibility", "agent_instruction_scan"]


def any_of(patterns: list[str]) -> str:
    """One pattern that matches where any of them does; each keeps its flag."""
    return "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns)


def any_by_start(patterns: list[str]) -> str:
    """As ``any_of``, for patterns without alternatives outside of brackets: what
    several begin with stands once, so it is looked for once at each place."""
    groups: dict[tuple[str, str], list[str]] = {}
    for p in patterns:
        flag, rest = ("i", p[4:]) if p.startswith("(?i)") else ("", p)
        start = next((x for x in ("(?:^|/)", "^", r"\.", "/") if rest.startswith(x)), "")
        groups.setdefault((flag, start), []).append(rest.removeprefix(start))
    return "|".join(f"(?{flag}:{start}(?:{'|'.join(rests)}))" for (flag, start), rests in groups.items())
