"""Rules of the scanners as data. Patterns, names and severities are fixed values."""

from __future__ import annotations

from typing import NamedTuple

SEVERITIES = ("critical", "high", "medium", "low", "info")


class LineRule(NamedTuple):
    """A rule that a line meets by a pattern, and by one of some words (any case) if there are any."""

    rule_id: str
    category: str
    severity: str
    title: str
    pattern: str
    words: tuple[str, ...] = ()
    #: Group of the pattern that the title carries.
    group: int = 0
    suggestion: str = ""


#: Secrets, in the order in which they are tried; the first that fits is the finding.
SECRETS = (
    ("hardcoded_password", "critical", "Password written into the source", r"""(?i)(password|passwd|pwd|secret)\s*=\s*['"](?!.*\$\{).{4,}"""),
    ("hardcoded_api_key", "critical", "API key written into the source", r"""(?i)(api[-_]?key|apikey|access[-_]?key)\s*=\s*['"].{8,}"""),
    ("aws_key_id", "critical", "Id of an AWS access key", r"AKIA[0-9A-Z]{16}"),
    ("aws_secret", "critical", "Secret part of an AWS access key", r"""(?i)aws.{0,20}secret.{0,20}['"][A-Za-z0-9+/]{40}['"]"""),
    ("github_token", "critical", "Token for GitHub", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("jwt_secret", "high", "Signing secret written into the source", r"""(?i)(jwt|token|signing)[-_]?(secret|key)\s*=\s*['"].{8,}"""),
    ("private_key_pem", "critical", "Private key in PEM form", r"-----BEGIN (RSA|EC|DSA|OPENSSH)? ?PRIVATE KEY-----"),
    ("connection_string", "high", "Database address written into the source", r"""(?i)jdbc:[a-z]+://[^\s'"]{10,}"""),
    ("generic_token", "high", "Bearer token written into the source", r"""(?i)(bearer|token)\s*[=:]\s*['"][A-Za-z0-9._\-]{16,}"""),
    ("hardcoded_ip", "low", "IP address written into the source", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("hardcoded_url", "low", "Long address, perhaps with a secret in it", r"""https?://[^\s'"]{20,}"""),
)

#: Line rules in scan order; the empty catch block, which looks ahead, stands among them by its place.
LINE_RULES = (
    LineRule("sql_injection", "vulnerability", "critical", "Possible SQL injection", r"\.(execute|executeQuery|executeUpdate|prepareStatement|createQuery)\s*\(", ("+", "concat"), suggestion="Bind parameters instead of joining strings."),
    LineRule("command_injection", "vulnerability", "critical", "Possible command injection", r"Runtime\.getRuntime\(\)\.exec|ProcessBuilder", ("+", "input", "param"), suggestion="Pass a checked list of arguments and no shell."),
    LineRule("unsafe_deserialization", "vulnerability", "high", "Unsafe deserialization", r"ObjectInputStream|readObject\(\)|XStream|Kryo|Hessian", suggestion="Use a data format, or filter the classes that may be read."),
    LineRule("weak_cryptography", "vulnerability", "high", "Weak cryptographic algorithm: ", r"""getInstance\(\s*["']?(MD5|SHA-?1|DES|RC4|ECB)["']?""", group=1, suggestion="Use SHA-256 or SHA-3, AES-GCM, and a password hash for passwords."),
    LineRule("empty_catch_block", "vulnerability", "medium", "Empty catch block", r"catch\s*\([^)]+\)\s*\{", suggestion="Log the exception or pass it on."),
    LineRule("path_traversal", "vulnerability", "high", "Possible path traversal", r"new\s+File\s*\(|Paths\.get\s*\(|FileInputStream\s*\(", ("request", "param", "input"), suggestion="Resolve the path and check that it is below its base."),
    LineRule("xxe_risk", "vulnerability", "high", "XML parser may read external entities", r"DocumentBuilderFactory|SAXParserFactory|XMLInputFactory", suggestion="Switch document types and external entities off."),
    LineRule("todo_comment", "smell", "info", " comment left in code", r"(?i)//\s*(TODO|FIXME|HACK|XXX|TEMP)[\s:]", group=1, suggestion="Track the work in an issue."),
)

EMPTY_CATCH = r"catch\s*\([^)]+\)\s*\{\s*\}"

#: Integrations: kind, type, direction, pattern, and the pattern whose first group is the detail.
INTEGRATIONS = (
    ("database", "JpaRepository", "outbound", r"JpaRepository|CrudRepository|PagingAndSortingRepository|JpaSpecificationExecutor", r"interface\s+(\w+)\s+extends"),
    ("database", "JdbcTemplate", "outbound", r"JdbcTemplate|NamedParameterJdbcTemplate", None),
    ("database", "EntityManager", "outbound", r"EntityManager", None),
    ("database", "QueryDSL", "outbound", r"JPAQueryFactory|QuerydslPredicateExecutor", None),
    ("cache", "Redis", "outbound", r"RedisTemplate|StringRedisTemplate|ReactiveRedisTemplate|RedissonClient", None),
    ("cache", "@Cacheable", "outbound", r"@Cacheable|@CachePut|@CacheEvict", r'@Cache(?:able|Put|Evict)\s*\(\s*(?:value\s*=\s*)?"([^"]+)"'),
    ("rest_client", "RestTemplate", "outbound", r"RestTemplate", None),
    ("rest_client", "WebClient", "outbound", r"WebClient|WebClientBuilder", r'baseUrl\s*\(\s*"([^"]+)"'),
    ("rest_client", "RestClient", "outbound", r"RestClient\.create|RestClient\.builder", None),
    ("rest_client", "@FeignClient", "outbound", r"@FeignClient", r"""@FeignClient\s*\(\s*(?:name\s*=\s*)?["']([^"']+)["']"""),
    ("rest_client", "OpenFeign", "outbound", r"feign\.client|FeignBuilder", None),
    ("messaging", "KafkaTemplate", "outbound", r"KafkaTemplate", r'send\s*\(\s*"([^"]+)"'),
    ("messaging", "@KafkaListener", "inbound", r"@KafkaListener", r'topics\s*=\s*\{?\s*"([^"]+)"'),
    ("messaging", "KafkaProducer", "outbound", r"KafkaProducer", None),
    ("messaging", "RabbitTemplate", "outbound", r"RabbitTemplate|AmqpTemplate", r'convertAndSend\s*\(\s*"([^"]+)"'),
    ("messaging", "@RabbitListener", "inbound", r"@RabbitListener", r'queues\s*=\s*\{?\s*"([^"]+)"'),
    ("messaging", "SqsClient", "outbound", r"SqsClient|SqsTemplate|SqsAsyncClient", None),
    ("messaging", "@SqsListener", "inbound", r"@SqsListener", r'@SqsListener\s*\(\s*"([^"]+)"'),
    ("messaging", "SnsClient", "outbound", r"SnsClient|SnsTemplate", None),
    ("messaging", "JmsTemplate", "outbound", r"JmsTemplate", None),
    ("messaging", "@JmsListener", "inbound", r"@JmsListener", r'destination\s*=\s*"([^"]+)"'),
    ("async", "@Async", "both", r"@Async|@EnableAsync", None),
    ("async", "ExecutorService", "both", r"ExecutorService|ThreadPoolTaskExecutor|CompletableFuture", None),
    ("external", "SMTP", "outbound", r"JavaMailSender|MimeMessage|SimpleMailMessage", None),
    ("external", "S3", "outbound", r"S3Client|AmazonS3|S3Template", r'"([a-z0-9.-]{3,63})"'),
    ("external", "Elasticsearch", "outbound", r"ElasticsearchClient|ElasticsearchRepository|RestHighLevelClient", None),
    ("external", "MongoDB", "outbound", r"MongoRepository|MongoTemplate|ReactiveMongoRepository", None),
    ("external", "DynamoDB", "outbound", r"DynamoDbClient|DynamoDbTable|DynamoDBMapper", None),
)

TABLE = r'(?s)@Table\s*\(.*?name\s*=\s*"([^"]+)"(?:.*?schema\s*=\s*"([^"]+)")?'
ENTITY = r'@Entity(?:\s*\(\s*name\s*=\s*"([^"]+)"\s*\))?'
FEIGN = r"@FeignClient\s*\(([^)]+)\)"
FIELD = r"private\s+(?:final\s+)?([\w]+)[\w<>, ]*\s+(\w+)\s*;"
TYPE_NAME = r"(?:public|private|protected)?\s*(?:class|interface)\s+(\w+)"
METHOD = r"(?:public|private|protected)\s+[\w<>\[\]]+\s+(\w+)\s*\([^)]*\)\s*(?:throws[^{]+)?\{"
CALL = r"(\w+)\.(\w+)\s*\("
CACHE_OPERATION = r"""@(Cacheable|CachePut|CacheEvict)\s*[\(\s][^)]*?["']([^"']+)["']"""
SECURED = r"@Secured\s*\(\s*\{?([^)}]+)"

CONSUMERS = (
    ("kafka", r'@KafkaListener\s*\([^)]*topics\s*=\s*\{?\s*"([^"]+)"'),
    ("rabbit", r'@RabbitListener\s*\([^)]*queues\s*=\s*\{?\s*"([^"]+)"'),
    ("sqs", r'@SqsListener\s*\(\s*"([^"]+)"'),
    ("jms", r'@JmsListener\s*\([^)]*destination\s*=\s*"([^"]+)"'),
)
GROUP_ID = r'groupId\s*=\s*"([^"]+)"'
CLASS_NAME = r"(?:public|private|protected)?\s*class\s+(\w+)"
HANDLER = r"(?:public|private)\s+\w+\s+(\w+)\s*\("
