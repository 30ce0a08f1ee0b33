SELECT status, param_source, count(*) AS runs
FROM {executions}
WHERE created_at >= :since
GROUP BY status, param_source
