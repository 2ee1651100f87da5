"""Property catalogs of the managed database."""

# fixed values: properties that cannot be changed on an existing cluster
INTERNAL_PROPERTIES = """
    wal_segment_size integer_datetimes update_process_title current_logic_cluster instr_unique_sql_track_type
    sql_compatibility max_function_args enable_adio_function server_version server_version_num wal_block_size
    max_identifier_length block_size lc_collate lc_ctype server_encoding max_index_keys segment_size
    percentile port
""".split()

# fixed values: properties that need a restart to take effect
RESTART_PROPERTIES = """
    recovery_parallelism max_files_per_process numa_distribute_mode transparent_encrypt_kms_region
    max_cached_tuplebufs enable_delta_store enable_ffic_log wal_level recovery_max_workers
    xlog_idle_flushes_before_sleep UDFWorkerMemHardLimit enableSeparationOfDuty alarm_component
    max_connections shared_preload_libraries config_file shared_buffers pgxc_node_name query_log_directory
    wal_buffers perf_directory local_bind_address comm_sctp_port hot_standby max_compile_functions
    transparent_encrypt_kms_url data_replicate_buffer_size thread_pool_attr max_locks_per_transaction
    comm_control_port sync_config_strategy wal_receiver_buffer_size wal_file_init_num comm_memory_pool
    ssl_ciphers unix_socket_directory comm_sender_buffer_size job_queue_processes comm_memory_pool_percent
    enable_default_cfunc_libpath xloginsert_locks advance_xlog_file_num enable_memory_limit hba_file
    recovery_parse_workers max_inner_tool_connections cn_send_buffer_size autovacuum_max_workers
    memorypool_size data_sync_retry max_wal_senders enable_stateless_pooler_reuse ssl max_resource_package
    data_directory max_prepared_transactions max_pred_locks_per_transaction ssl_crl_file
    elastic_search_ip_addr recovery_redo_workers transparent_encrypted_string enable_incremental_checkpoint
    ssl_key_file replication_type audit_directory string_hash_compatible local_syscache_threshold
    enable_orc_cache walsender_max_send_size ssl_ca_file comm_max_receiver
    max_concurrent_autonomous_transactions allow_system_table_mods remote_read_mode password_encryption_type
    enable_mix_replication sysadmin_reserved_connections support_extended_features max_process_memory
    udf_memory_limit autovacuum_freeze_max_age catchup2normal_wait_time asp_log_directory asp_sample_num
    available_zone bgwriter_thread_num wal_writer_cpu logging_collector enable_alarm comm_usable_memory
    unix_socket_permissions listen_addresses unix_socket_group memorypool_enable comm_quota_size
    lastval_supported wal_log_hints enable_page_lsn_check track_activity_query_size max_replication_slots
    comm_tcp_mode event_source enable_nonsysadmin_execute_direct bbox_blanklist_items pagewriter_thread_num
    enable_thread_pool audit_data_format use_elastic_search ident_file enable_global_plancache
    enable_double_write max_changes_in_memory force_promote ssl_cert_file external_pid_file cstore_buffers
    mot_config_file
""".split()
