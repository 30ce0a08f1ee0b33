SELECT x.id, x.handler_name, x.created_at, coalesce(d.name, x.handler_name) AS job_name
FROM {executions} x LEFT JOIN {definitions} d ON d.id = x.job_id
WHERE x.status = 'PENDING' AND x.created_at >= :since
ORDER BY x.created_at, x.id
LIMIT :n
