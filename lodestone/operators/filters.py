"""Built-in filters of command output. Patterns, limits and messages."""

from lodestone.operators.lines import Filter

FILTERS = {
    'aws::generic': Filter(width=200, most=80),
    'aws::logs': Filter(preprocess='group_repeated', width=200, tail=100),
    'aws::sts': Filter(most=20),
    'aws::s3': Filter(width=160, most=80),
    'aws::ec2': Filter(strip=(r'^\s*"AmiLaunchIndex":', r'^\s*"ProductCodes":', r'^\s*"ClientToken":', r'^\s*"Hypervisor":', r'^\s*"VirtualizationType":', r'^\s*"EnaSupport":', r'^\s*"SriovNetSupport":',), width=200, most=120),
    'aws::lambda': Filter(strip=(r'^\s*"CodeSha256":', r'^\s*"RevisionId":', r'^\s*"MasterArn":',), width=200, most=120),
    'aws::iam': Filter(preprocess='strip_policy_documents', width=200, most=80),
    'aws::dynamodb': Filter(preprocess='unwrap_dynamodb_types', width=200, most=120),
    'aws::cloudformation': Filter(strip=(r'^\s*"StackId":', r'^\s*"RoleARN":', r'^\s*"ChangeSetId":',), width=200, most=120),
    'cargo::test': Filter(keep=(r"^test ", r"FAILED", r"^running \d+", r"^\d+ passed", r"test result", r"^error", r"^thread '", r"^note:",), tail=40, on_empty='(sem saída de testes)'),
    'cargo::build': Filter(keep=(r"^error", r"^warning", r"^  -->", r"Finished|Compiling|error\[",), most=100, on_empty='(build sem erros ou avisos)'),
    'cargo::fmt': Filter(most=50, on_empty='(formatação ok)'),
    'cargo::run': Filter(most=200),
    'data::curl': Filter(width=200, most=100),
    'data::jq': Filter(most=100),
    'data::sqlite3': Filter(width=150, most=100),
    'docker::ps': Filter(width=120, most=50),
    'docker::logs': Filter(preprocess='group_repeated', width=200, tail=100),
    'gh::pr_list': Filter(most=30),
    'gh::pr_view': Filter(most=60),
    'gh::issue_list': Filter(most=30),
    'gh::run_list': Filter(most=30),
    'gh::generic': Filter(most=80),
    'git::status': Filter(most=50, on_empty='(working tree clean)'),
    'git::log': Filter(preprocess='preprocess_git_log', width=120, head=30),
    'git::diff': Filter(strip=(r"^Binary files", r"^\+\s*$", r"^-\s*$",), most=150),
    'git::show': Filter(strip=(r"^Binary files", r"^\+\s*$", r"^-\s*$", r"^index [0-9a-f]+\.\.[0-9a-f]+",), most=150),
    'git::blame': Filter(width=100, most=100),
    'git::push': Filter(preprocess='reduce_push_to_ok', match=(('Everything up-to-date', 'ok (up to date)'),), keep=(r"->", r"\* \[new (branch|tag)\]", r"\[rejected\]", r"^\s*[0-9a-f]{7,40}\.\.[0-9a-f]{7,40}",), most=3, on_empty='ok'),
    'git::pull': Filter(match=(('Already up.to.date', 'ok (already up to date)'),), keep=(r"Fast-forward", r"file[s]? changed", r"CONFLICT", r"Merge", r"->",), most=5, on_empty='ok'),
    'git::add': Filter(most=10, on_empty='ok'),
    'git::commit': Filter(preprocess='reduce_commit_to_ok', keep=(r"^ok\s", r"nothing to commit", r"error:", r"fatal:",), most=3, on_empty='ok'),
    'git::generic': Filter(most=100),
    'go::test': Filter(keep=(r"^---\s+(FAIL|PASS):", r"^(FAIL|ok|PASS)\s+", r"^\s+.+_test\.go:\d+:", r"^FAIL\b", r"panic:",), most=150, on_empty='ok'),
    'go::build': Filter(keep=(r"^\S+\.go:\d+:\d+:", r"^# ", r"error", r"undefined:",), most=80, on_empty='ok'),
    'go::golangci': Filter(keep=(r"\.go:\d+:\d+:", r"^Error:", r"^level=error",), most=200, on_empty='ok'),
    'jvm::gradle_test': Filter(strip=(r"^> Task :", r"^Download ",), keep=(r"FAILED", r"BUILD FAILED", r"BUILD SUCCESSFUL", r"tests completed", r"Exception", r"Error at", r"SpockAssertionError", r"AssertionError", r"ArithmeticException", r"FAILURE:", r"What went wrong", r"There were failing tests",), most=100, on_empty='(testes concluídos sem falhas)'),
    'jvm::gradle_build': Filter(strip=(r"^> Task :", r"^Download ",), keep=(r"error:", r"BUILD FAILED", r"BUILD SUCCESSFUL", r"Compilation failed",), most=80, on_empty='(build concluído sem erros)'),
    'jvm::mvn_test': Filter(strip=(r"^\[INFO\]",), most=80, on_empty='(testes Maven concluídos sem erros)'),
    'jvm::mvn_build': Filter(strip=(r"^\[INFO\]",), most=80, on_empty='(build Maven concluído sem erros)'),
    'jvm::grails_run': Filter(strip=(r"Mapped URL path", r"Mapping: ", r"Bean:", r"Initializing Spring",), most=50),
    'jvm::grails_test': Filter(strip=(r"^> Task :", r"^Download ",), keep=(r"FAILED", r"BUILD FAILED", r"BUILD SUCCESSFUL", r"tests completed", r"Error", r"Exception",), most=100, on_empty='(testes Grails concluídos sem falhas)'),
    'kubectl::get': Filter(width=120, most=50),
    'kubectl::logs': Filter(preprocess='group_repeated', width=200, tail=100),
    'nav::ls': Filter(width=120, most=80),
    'nav::find': Filter(strip=(r"^find: ",), most=200),
    'nav::tree': Filter(most=100),
    'nav::grep': Filter(width=150, most=150),
    'node::install': Filter(keep=(r"^(npm warn|npm error|error|ERR!|added \d+|removed \d+|changed \d+)",), most=50, on_empty='(instalação concluída)'),
    'node::test': Filter(keep=(r"FAIL|PASS|✓|✗|×|●|FAILED|passed|failed|Tests:", r"^  ●", r"Test Suites:",), tail=50, on_empty='(sem resultados de testes)'),
    'node::build': Filter(keep=(r"error|Error|warning|warn|✓|✗|built in",), most=80, on_empty='(build concluído)'),
    'node::run_script': Filter(most=100),
    'python::pytest': Filter(keep=(r"FAILED|PASSED|ERROR|WARNING", r"^={3,}", r"^ERRORS|^FAILURES|short test summary", r"^\s+File ", r"AssertionError|Exception",), tail=40, on_empty='(sem resultados de testes)'),
    'python::generic': Filter(most=100),
    'python::ruff': Filter(keep=(r"\.py:\d+:\d+:\s+[A-Z]\d+", r"^Found \d+ error", r"^All checks passed",), most=200, on_empty='ok'),
    'python::mypy': Filter(keep=(r"\.py:\d+:\s+(error|note|warning)", r"^Found \d+ error", r"^Success: no issues",), most=200, on_empty='ok'),
    'ruby::rubocop': Filter(keep=(r"\.rb:\d+:\d+:", r"files? inspected", r"offenses? detected", r"no offenses detected",), most=200, on_empty='ok'),
    'ruby::rspec': Filter(keep=(r"^Finished in", r"\d+ examples?,\s+\d+ failures?", r"^Failed examples:", r"^rspec\s+\./spec", r"^\s+Failure/Error:", r"^\s+expected:", r"^\s+got:", r"^Pending:",), most=200, on_empty='ok'),
    'ruby::rake': Filter(most=120),
    'terraform::plan': Filter(strip=(r"^Initializing the backend\.\.\.", r"^Initializing provider plugins\.\.\.", r"^- Finding ", r"^- Installing ", r"^- Installed ", r"^- Using previously-installed ", r"^Refreshing state\.\.\.", r"^.* Refreshing state\.\.\.", r"^.* Reading\.\.\.", r"^.* Read complete after", r"^Acquiring state lock", r"^Releasing state lock", r"^Terraform has compared", r"^Note: Objects have changed outside", r"^Unless you have made equivalent", r"^Terraform will perform the following actions:",), width=200, most=200, on_empty='(no changes)'),
    'terraform::apply': Filter(keep=(r"Apply complete", r"Error:", r"Warning:", r"Resources:", r"Outputs:", r": Creating\.\.\.", r": Destroying\.\.\.", r": Modifying\.\.\.", r": Creation complete", r": Destruction complete", r": Modifications complete",), most=80),
    'terraform::init': Filter(keep=(r"Terraform has been successfully initialized", r"OpenTofu has been successfully initialized", r"Error:", r"Warning:",), most=10, on_empty='ok'),
    'terraform::validate': Filter(keep=(r"Success!", r"Error:", r"Warning:",), most=20, on_empty='ok'),
    'ts::tsc': Filter(keep=(r"\.(ts|tsx|js|jsx|d\.ts)\(\d+,\d+\):\s*(error|warning)", r"^Found \d+ error",), most=200, on_empty='ok (no type errors)'),
    'ts::eslint': Filter(strip=(r"^✖ \d+ problems? \(\d+ errors?, \d+ warnings?\)\s*$",), keep=(r"^\s*\d+:\d+\s+(error|warning)", r"\.(ts|tsx|js|jsx)$", r"^\s*\d+\s+problems?\s+\(\d+\s+errors?",), most=200, on_empty='ok (no lint errors)'),
    'ts::prettier': Filter(keep=(r"^\[warn\]\s+", r"^Code style issues found", r"^All matched files use Prettier code style",), most=100, on_empty='ok (no formatting issues)'),
    'ts::biome': Filter(keep=(r"×", r"^\s*\w+/\w+/\w+", r"^Found \d+ ", r"^Checked \d+ file", r"errors? found",), most=200, on_empty='ok'),
}
FILTERS['cargo::clippy'] = FILTERS['cargo::build']
FILTERS['docker::images'] = FILTERS['docker::ps']
FILTERS['docker::compose_ps'] = FILTERS['docker::ps']

#: Filter by the first two words of a command.
KEYS = {
    'aws logs': 'aws::logs',
    'aws sts': 'aws::sts',
    'aws s3': 'aws::s3',
    'aws s3api': 'aws::s3',
    'aws ec2': 'aws::ec2',
    'aws lambda': 'aws::lambda',
    'aws iam': 'aws::iam',
    'aws dynamodb': 'aws::dynamodb',
    'aws cloudformation': 'aws::cloudformation',
    'aws cfn': 'aws::cloudformation',
    'cargo test': 'cargo::test',
    'cargo build': 'cargo::build',
    'cargo check': 'cargo::build',
    'cargo install': 'cargo::build',
    'cargo clippy': 'cargo::clippy',
    'cargo fmt': 'cargo::fmt',
    'cargo run': 'cargo::run',
    'docker ps': 'docker::ps',
    'docker images': 'docker::images',
    'docker logs': 'docker::logs',
    'docker compose': 'docker::compose_ps',
    'gh pr': 'gh::pr_list',
    'gh issue': 'gh::issue_list',
    'gh run': 'gh::run_list',
    'git status': 'git::status',
    'git log': 'git::log',
    'git diff': 'git::diff',
    'git show': 'git::diff',
    'git blame': 'git::blame',
    'git push': 'git::push',
    'git pull': 'git::pull',
    'git fetch': 'git::pull',
    'git add': 'git::add',
    'git commit': 'git::commit',
    'git branch': 'git::generic',
    'git tag': 'git::generic',
    'git stash': 'git::generic',
    'go test': 'go::test',
    'go build': 'go::build',
    'go vet': 'go::golangci',
    'golangci-lint run': 'go::golangci',
    'golangci-lint': 'go::golangci',
    'gradle test': 'jvm::gradle_test',
    'gradlew test': 'jvm::gradle_test',
    './gradlew test': 'jvm::gradle_test',
    'gradle build': 'jvm::gradle_build',
    'gradlew build': 'jvm::gradle_build',
    './gradlew build': 'jvm::gradle_build',
    'mvn test': 'jvm::mvn_test',
    './mvnw test': 'jvm::mvn_test',
    'mvn build': 'jvm::mvn_build',
    'mvn package': 'jvm::mvn_build',
    'mvn install': 'jvm::mvn_build',
    'mvn verify': 'jvm::mvn_build',
    './mvnw build': 'jvm::mvn_build',
    'grails run-app': 'jvm::grails_run',
    'grails test-app': 'jvm::grails_test',
    'kubectl get': 'kubectl::get',
    'kubectl describe': 'kubectl::get',
    'kubectl logs': 'kubectl::logs',
    'npm install': 'node::install',
    'yarn install': 'node::install',
    'pnpm install': 'node::install',
    'npm test': 'node::test',
    'yarn test': 'node::test',
    'pnpm test': 'node::test',
    'npm build': 'node::build',
    'yarn build': 'node::build',
    'pnpm build': 'node::build',
    'npm run': 'node::run_script',
    'ruff check': 'python::ruff',
    'ruff format': 'python::ruff',
    'mypy': 'python::mypy',
    'rubocop': 'ruby::rubocop',
    'bundle exec rubocop': 'ruby::rubocop',
    'rspec': 'ruby::rspec',
    'bundle exec rspec': 'ruby::rspec',
    'rake spec': 'ruby::rspec',
    'rake test': 'ruby::rake',
    'bundle exec rake': 'ruby::rake',
    'terraform plan': 'terraform::plan',
    'tofu plan': 'terraform::plan',
    'terraform apply': 'terraform::apply',
    'tofu apply': 'terraform::apply',
    'terraform init': 'terraform::init',
    'tofu init': 'terraform::init',
    'terraform validate': 'terraform::validate',
    'tofu validate': 'terraform::validate',
    'tsc': 'ts::tsc',
    'npx tsc': 'ts::tsc',
    'pnpm tsc': 'ts::tsc',
    'eslint': 'ts::eslint',
    'npx eslint': 'ts::eslint',
    'pnpm eslint': 'ts::eslint',
    'prettier': 'ts::prettier',
    'npx prettier': 'ts::prettier',
    'biome': 'ts::biome',
}

#: Filter by the first word alone.
GENERIC = {
    'aws': 'aws::generic',
    'cargo': 'cargo::build',
    'curl': 'data::curl',
    'wget': 'data::curl',
    'jq': 'data::jq',
    'sqlite3': 'data::sqlite3',
    'docker': 'docker::ps',
    'gh': 'gh::generic',
    'git': 'git::generic',
    'go': 'go::build',
    'golangci-lint': 'go::golangci',
    'kubectl': 'kubectl::get',
    'ls': 'nav::ls',
    'find': 'nav::find',
    'tree': 'nav::tree',
    'grep': 'nav::grep',
    'rg': 'nav::grep',
    'ag': 'nav::grep',
    'jest': 'node::test',
    'vitest': 'node::test',
    'npm': 'node::run_script',
    'yarn': 'node::run_script',
    'pnpm': 'node::run_script',
    'pytest': 'python::pytest',
    'python': 'python::generic',
    'python3': 'python::generic',
    'ruff': 'python::ruff',
    'mypy': 'python::mypy',
    'rubocop': 'ruby::rubocop',
    'rspec': 'ruby::rspec',
    'rake': 'ruby::rake',
    'terraform': 'terraform::plan',
    'tofu': 'terraform::plan',
    'tsc': 'ts::tsc',
    'eslint': 'ts::eslint',
    'prettier': 'ts::prettier',
    'biome': 'ts::biome',
}
